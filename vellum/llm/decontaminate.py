"""Benchmark leaks by template canonicalisation, with built-in functions only.

Tokens become templates: a number turns into <num>, a unit after a number into <unit>,
other words are lower-cased.  The words that an item of five tokens or more uses as
names (a capital inside a sentence anywhere in the item; its other places count too)
are <name> in the item: any word may stand there.  Documents needn't show what a name
is, so copies in other letter cases and with other names meet all the same.

Template windows of documents are hash-joined with those of the benchmark: of five
tokens, or of all tokens of an item that has fewer.  A window with one or two names
is hashed with these places blank, in the document too; with more names it has to agree
word for word.  Only each item's first windows are looked for in all documents, so
many that a document that holds 0.8 of them has one: those without names before
others, rare ones first, so that few ways of blanking are needed.  Where one is found,
the document is laid beside the item, on that alignment and on those up to BAND tokens
from it, and all windows are compared.  On one alignment, or on alignments that lie
BAND tokens apart at most, as words put in or left out make them, at least 0.8 of the
item's windows must occur; then the slots are compared: a re-parameterised question
puts the same new value wherever the item repeats an old one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm.store import unused, written

WINDOW, SIMILARITY, BAND = 5, 0.8, 4
#: Names of a window of five tokens up to which their places are blank.
NAMES = 2
#: Benchmark windows up to which they are broadcast; beyond, the join is shuffled.
BROADCAST_WINDOWS = 200_000
#: Documents with slots to compare up to which their ids are broadcast; beyond, that join is shuffled.
BROADCAST_IDS = 1_000_000
#: A word with inner marks, and the mark that ends a sentence after it.
TOKEN = r"[\p{L}\p{N}]+(?:[.,'’-][\p{L}\p{N}]+)*[.!?:]?"
# Units that count as one slot after a number.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "ton", "tons", "ounce", "ounces", "pound", "pounds",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "cup", "cups",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "percent",
)


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))


def bare(word: Column) -> Column:
    return F.rtrim(word, F.lit(".!?:"))


def template(words: Column) -> Column:
    """The templates of an array of tokens, one for each, without names."""

    def one(w: Column, i: Column) -> Column:
        low = F.lower(bare(w))
        return F.when(F.ascii(w).between(48, 57), F.lit("<num>")).when(F.ascii(F.get(words, i - 1)).between(48, 57) & low.isin(*UNITS), F.lit("<unit>")).otherwise(low)

    return F.transform(words, one)


def names(words: Column) -> Column:
    """The words, in lower case, that begin with a capital inside a sentence; no single letters and none all in capitals."""

    def told(w: Column, i: Column) -> Column:
        before, first = F.get(words, i - 1), F.ascii(w)
        capital = first.between(65, 90) | ((first > 127) & (F.lower(bare(w)) != bare(w)))
        inside = before.isNotNull() & ~F.substring(before, -1, 1).isin(".", "!", "?", ":")
        return F.when(capital & inside & (F.length(bare(w)) > 1) & (F.upper(bare(w)) != bare(w)), F.lower(bare(w)))

    return F.filter(F.transform(words, told), lambda w: w.isNotNull())


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blanked(tpl: Column, at: Column, size: int, mask: int) -> Column:
    """The window of ``tpl`` that starts at ``at``, from 1, blank where ``mask`` has a bit, the first token's the lowest."""
    if not mask:
        return F.slice(tpl, at, size)
    return F.array(*(F.lit("<name>") if mask >> k & 1 else F.get(tpl, at + (k - 1)) for k in range(size)))


def windows(rows: DataFrame, key: str, forms: list[tuple[int, int]]) -> DataFrame:
    """(key, at, h): the hash of each template window and the token, from 1, where it starts, for each (size, mask) of ``forms``.

    Hashes are made as an array and exploded alone: a row that carried the whole template
    would copy it each time.
    """

    def hashed(tpl: Column) -> Column:
        n = F.size(tpl)

        def of(size: int, mask: int) -> Column:
            last = F.greatest(n - (size - 1), F.lit(0))
            return F.transform(F.sequence(F.lit(0), last), lambda i: F.when(i > 0, F.struct(i.alias("at"), F.xxhash64(blanked(tpl, F.greatest(i, F.lit(1)), size, mask)).alias("h"))))

        return F.filter(F.concat(*(of(*f) for f in forms)) if len(forms) > 1 else of(*forms[0]), lambda x: x.isNotNull())

    return rows.select(key, F.inline(_let(tokens("text"), lambda ws: _let(template(ws), hashed))))


def _prepared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, words, tpl), words bare and in lower case. The tokens are bound once for each row; as a plain column the lambda would find them anew for each word."""
    both = F.transform(F.array(tokens("text")), lambda ws: F.struct(F.transform(ws, lambda w: F.lower(bare(w))).alias("words"), template(ws).alias("tpl")))
    return rows.select(*keys, F.inline(both))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, version, words, tpl, wild, k, masks) of each different text with a token: which tokens are names, tokens of a window, and each window's mask."""
    texts = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().withColumn("version", F.xxhash64("text"))
    both = F.transform(F.array(tokens("text")), lambda ws: F.struct(F.transform(ws, lambda w: F.lower(bare(w))).alias("words"), template(ws).alias("tpl"), names(ws).alias("names")))
    rows = texts.select("item_id", "version", F.inline(both)).where(F.size("words") > 0).withColumn("k", F.least(F.size("words"), F.lit(WINDOW)))
    named = lambda t, i: (F.col("k") == WINDOW) & ~t.isin("<num>", "<unit>") & F.array_contains(F.col("names"), F.get(F.col("words"), i))
    rows = rows.withColumn("wild", F.transform("tpl", named)).drop("names")
    bits = lambda i: [F.coalesce(F.get(F.col("wild"), i + k), F.lit(False)).cast("int") for k in range(WINDOW)]

    def mask(i: Column) -> Column:
        set_ = bits(i)
        return F.when((F.col("k") == WINDOW) & (sum(set_) <= NAMES), sum(b * (1 << k) for k, b in enumerate(set_))).otherwise(0)

    return rows.withColumn("masks", F.transform(F.sequence(F.lit(0), F.size("tpl") - F.col("k")), mask))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, at, n_windows, n_hits, n_changed): where a document holds an item.

    ``at`` is the token, from 1, where the item's first would stand; n_changed counts
    the slots whose values differ, letter case aside.  Items without a token match
    nothing; one of fewer than five tokens is found where they all stand in a row.  Each
    different text of a repeated item_id is searched.  Repeated doc_ids are taken as one.
    Rows with a null id are left out.
    """
    items = written(_items(benchmark), "items")
    key = ["item_id", "version"]
    each = items.select(*key, "k", "tpl", F.posexplode("masks").alias("i", "mask"))
    hashes = F.xxhash64(F.transform(F.slice("tpl", F.col("i") + 1, F.col("k")), lambda t, j: F.when(F.col("mask").bitwiseAND(F.pow(F.lit(2), j).cast("int")) != 0, F.lit("<name>")).otherwise(t)))
    found = written(each.select(*key, "k", "mask", (F.col("i") + 1).alias("item_at"), hashes.alias("h")), "windows")

    # a document with SIMILARITY of an item's n windows lacks at most the rest, so of one window more it has one
    per_item = Window.partitionBy(*key)
    rest = 1 + F.floor((1 - SIMILARITY) * F.count("*").over(per_item) + 1e-9)
    shared = found.groupBy("h").agg(F.count("*").alias("items"))
    common = found.groupBy("mask").agg(F.count("*").alias("often"))  # 2^WINDOW rows at most
    first = F.row_number().over(per_item.orderBy(F.col("mask") != 0, F.desc("often"), "mask", "items", "item_at"))
    probes = found.join(shared, "h").join(F.broadcast(common), "mask").select(*key, "k", "mask", "item_at", "h", first.alias("r"), rest.alias("rest")).where("r <= rest")
    probes = written(probes.select(*key, "k", "mask", "item_at", "h"), "probes")
    n = probes.count()
    few = (lambda df: F.broadcast(df)) if n <= BROADCAST_WINDOWS else (lambda df: df)
    forms = sorted((r.k, r.mask) for r in probes.select("k", "mask").distinct().collect()) or [(WINDOW, 0)]  # of sizes and masks there are 20 at most
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = windows(rows, "doc_id", forms).join(few(probes.select(*key, "item_at", "h")), "h")
    maybe = written(met.select("doc_id", *key, (F.col("at") - F.col("item_at")).alias("s")).distinct(), "maybe")

    asked = ["doc_id", *key]
    near_by = F.array_distinct(F.flatten(F.transform(F.collect_set("s"), lambda s: F.sequence(s - BAND, s + BAND))))
    pairs = maybe.groupBy(*asked).agg(near_by.alias("shifts"))
    texts = _prepared(rows.join(_few_ids(maybe), "doc_id", "left_semi"), ["doc_id"])
    laid = pairs.join(items.select(*key, F.col("tpl").alias("item"), "wild", "k", "masks"), key).join(texts.select("doc_id", "tpl"), "doc_id")
    # 2: the same, 1: a name's place with a word, 0: another or none
    agrees = lambda s: F.transform("item", lambda t, p: F.when(s + p < 0, 0).when(F.get(F.col("tpl"), F.greatest(s + p, F.lit(0))) == t, 2).when(F.get(F.col("wild"), p) & (s + p < F.size("tpl")), 1).otherwise(0))
    there = lambda m: F.filter(F.transform("masks", lambda mask, i: F.when(F.array_min(F.slice(m, i + 1, F.col("k"))) >= F.when(mask != 0, 1).otherwise(2), i + 1)), lambda i: i.isNotNull())
    # what is found is exploded, without the document's tokens
    at = F.transform("shifts", lambda s: F.struct(s.alias("s"), F.element_at(F.transform(F.array(agrees(s)), there), 1).alias("at")))
    hits = laid.select(*asked, F.size("masks").cast("long").alias("n_windows"), F.filter(at, lambda x: F.size(x["at"]) > 0).alias("found"))
    hits = hits.select(*asked, "n_windows", F.inline("found"))

    # a band begins with an alignment that has hits
    band = Window.partitionBy(*asked).orderBy("s").rangeBetween(0, BAND)
    enough = lambda n: n >= F.col("n_windows") * SIMILARITY
    bands = hits.withColumns({"in_all": F.sum(F.size("at")).over(band), "of_band": F.collect_list(F.struct("s", "at")).over(band)}).where(enough(F.col("in_all")))
    alone = enough(F.size("at"))
    n_band = F.size(F.array_distinct(F.flatten("of_band.at")))
    near = bands.where(alone | (enough(n_band) & ~F.exists("of_band", lambda x: enough(F.size(x["at"])))))
    own = F.when(alone, F.slice("of_band", 1, 1)).otherwise(F.col("of_band"))
    each_hit = F.flatten(F.transform(own, lambda x: F.transform(x["at"], lambda i: F.struct(x["s"].alias("s"), i.alias("item_at")))))
    near = written(near.select(*asked, F.col("s").alias("shift"), "n_windows", F.when(alone, F.size("at")).otherwise(n_band).cast("long").alias("n_hits"), alone.alias("alone"), each_hit.alias("hits")), "near")
    return written(_consistent(near, rows, items), "leaks")


def _few_ids(rows: DataFrame) -> DataFrame:
    ids = rows.select("doc_id").distinct()
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _consistent(near: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The alignments on which no value of an item's slots has two values in the document.

    A number or unit is compared where the document has one too, a name where a hit
    holds it.  In a band a slot stands where the hits that hold it put it, those of the
    alignment with most hits first; a slot that no hit holds isn't compared.
    """
    kind = lambda i: F.when(F.get(F.col("wild"), i), F.lit("<name>")).otherwise(F.get(F.col("tpl"), i))
    slot = lambda w, i: F.when(kind(i).isin("<num>", "<unit>", "<name>"), F.struct((i + 1).alias("p"), kind(i).alias("kind"), w.alias("v")))
    slots = items.select("item_id", "version", F.filter(F.transform("words", slot), lambda x: x.isNotNull()).alias("slots"))
    keys = ["doc_id", "item_id", "version", "shift", "n_windows", "n_hits"]
    asked = near.join(slots, ["item_id", "version"]).where(F.size("slots") > 0)
    words = _prepared(docs.join(_few_ids(asked), "doc_id", "left_semi"), ["doc_id"])
    holding = lambda p: F.filter("hits", lambda x: x["item_at"].between(p - (WINDOW - 1), p))
    best = lambda p: F.array_max(F.transform(holding(p), lambda x: F.struct(F.size(F.filter("hits", lambda y: y["s"] == x["s"])).alias("n"), (-x["s"]).alias("minus"))))

    def pair(s: Column) -> Column:
        name = s["kind"] == "<name>"
        at = F.when(F.col("alone") & ~name, F.col("shift")).otherwise(-best(s["p"])["minus"]) + s["p"]
        held = at.between(1, F.size("tpl")) & (name | (F.get(F.col("tpl"), at - 1) == s["kind"]))
        return F.when(held, F.struct(s["kind"].alias("kind"), s["v"].alias("old"), F.get(F.col("words"), at - 1).alias("new")))

    each = asked.join(words, "doc_id").select(*keys, F.filter(F.transform("slots", pair), lambda x: x.isNotNull()).alias("pairs"))
    each = each.select(*keys, F.inline("pairs"))
    by_value = each.groupBy(*keys, "kind", "old").agg(F.count_distinct("new").alias("news"), F.sum((F.col("new") != F.col("old")).cast("long")).alias("changed"))
    told = by_value.groupBy(*keys).agg(F.max("news").alias("news"), F.sum("changed").alias("n_changed"))
    every = near.select(*keys).join(told, keys, "left").where("coalesce(news, 1) = 1")
    return every.select("doc_id", "item_id", (F.col("shift") + 1).alias("at"), "n_windows", "n_hits", F.coalesce("n_changed", F.lit(0).cast("long")).alias("n_changed"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, item_ids, reworded) for every row of ``docs``.

    item_ids are the items found, ascending, empty if none; reworded tells whether one
    of them was found with other slot values only.  A null text holds no item; a
    null doc_id is never contaminated; an empty benchmark leaves all clean.
    """
    found = leaks(docs, benchmark).groupBy("doc_id", "item_id").agg(F.min("n_changed").alias("n_changed"))
    found = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max(F.col("n_changed") > 0).alias("reworded"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, "doc_id", "left")
    none = F.array().cast("array<bigint>")
    return every.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("reworded", F.lit(False)).alias("reworded"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    (gone_id,) = unused(docs, "gone_id")
    gone = leaks(docs, benchmark).select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[gone_id], "left_anti").select(*(f"`{c}`" for c in docs.columns))
