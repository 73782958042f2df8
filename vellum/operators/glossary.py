"""Terminology: matching, compliance, drift, merging and layering of glossaries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from vellum.functions import text as T
from vellum.sources import views as V

CAP = 40
#: Terms up to which every text is tested against all of them in place.
IN_PLACE = 500
#: Bytes of terms that an automaton of a task is made of; a larger glossary is looked for in shards of so much.
SHARD_BYTES = 16 << 20


def _finder(terms: list[str]):
    """A column function: the different terms, by one automaton of all, that each text contains."""

    @F.pandas_udf(ArrayType(StringType()))
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for t in terms:
            if t:
                automaton.add_word(t, t)
        always = [""] if "" in terms else []
        automaton.make_automaton()
        for texts in parts:
            none = not len(automaton)
            yield texts.map(lambda x: None if x is None else always if none else always + list({t for _, t in automaton.iter(x)}))  # noqa: B023

    return found


def matches(texts: DataFrame, terms: DataFrame, text: str = "src") -> DataFrame:
    """``texts`` x ``terms`` where the lower-cased text contains the term; terms are lower case.

    A small glossary rides along as a literal, tested inside the row.  A larger one is
    made an automaton, through which each text goes once; one of over SHARD_BYTES is
    dealt over shards, and the texts go through one automaton after another.  Only the
    text that is searched leaves the JVM.  Null texts and terms match nothing.
    """
    terms = terms.where(F.col("en").isNotNull())
    names = terms.columns
    low = F.lower(F.col(text))
    n, size = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("en")), F.lit(0))).first()
    if not n:
        return texts.join(terms.limit(0), F.lit(True))
    if n <= IN_PLACE:
        every = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in names]) for r in terms.collect()])
        bound = F.filter(every, lambda t: F.contains(low, t["en"]))
        return texts.withColumn("__t", F.explode(bound)).select(*texts.columns, *(F.col(f"__t.{c}").alias(c) for c in names))
    shards = -(-size // SHARD_BYTES)
    shard, out = F.pmod(F.xxhash64("en"), F.lit(shards)), None
    for k in range(shards):
        own = terms.where(shard == k) if shards > 1 else terms
        listed = [r.en for r in own.select("en").distinct().collect()]  # SHARD_BYTES or so
        hits = texts.withColumn("__en", F.explode(_finder(listed)(low)))
        met = hits.join(F.broadcast(own.withColumnRenamed("en", "__en")), "__en").select(*texts.columns, *(F.col("__en").alias("en") if c == "en" else F.col(c) for c in names))
        out = met if out is None else out.unionByName(met)
    return out


def occurrences(text: Column, term: Column) -> Column:
    """How often the lower-cased text has the term, without overlaps."""
    return ((F.length(text) - F.length(F.replace(F.lower(text), term, F.lit("")))) / F.length(term)).cast("long")


def capped(found: DataFrame, cap: int = CAP) -> DataFrame:
    """At most ``cap`` terms for each chunk: all locked ones, then the longest; everything where it fits."""
    chunk = Window.partitionBy("conv_id", "idx")
    order = chunk.orderBy(F.when(F.col("locked"), 0).otherwise(1), F.desc(F.length("en")), "ordinal")
    n = found.withColumn("n", F.count("*").over(chunk)).withColumn("rank", F.row_number().over(order))
    return n.where((F.col("n") <= cap) | F.col("locked") | (F.col("rank") <= cap)).select("conv_id", "idx", "en", "vi", "locked", "rank")


def compliance(found: DataFrame, least: int = 3) -> DataFrame:
    """Terms whose translation is missing in ``least`` blocks or more that contain them."""
    bad = found.where("trim(src) <> '' and trim(mt) <> ''").where(~F.contains(F.lower("mt"), F.lower("vi")))
    return bad.groupBy("en", "vi").agg(F.count("*").alias("violations")).where(F.col("violations") >= least)


def drift(found: DataFrame) -> DataFrame:
    """Terms left as they are in two chunks of a document or more; of each document the first five by glossary order."""
    left = found.where(F.contains(F.lower("mt"), F.col("en")) & ~F.contains(F.lower("mt"), F.lower("vi")) & (F.col("mt") != ""))
    g = left.groupBy("conv_id", "en", "ordinal").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("idx")).alias("chunks")).where("n >= 2")
    w = Window.partitionBy("conv_id")
    g = g.withColumn("terms", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("ordinal")))
    return g.where("k <= 5").select("conv_id", "en", "n", "chunks", F.round(F.least(F.lit(0.85), 0.55 + F.col("terms") * 0.06), 6).alias("confidence"))


def usage(found: DataFrame) -> DataFrame:
    """Occurrences, chunks and the share of occurrences in chunks that keep the translation, by term."""
    n = occurrences(F.col("src"), F.col("en"))
    ok = F.contains(F.lower("mt"), F.lower("vi")) | F.contains(F.lower("mt"), F.col("en"))
    return found.groupBy("en").agg(F.sum(n).alias("occurrences"), F.count("*").alias("chunks"), F.round(F.sum(F.when(ok, n).otherwise(0)) / F.sum(n), 6).alias("kept"))


def densest_chunks(found: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` chunks with most term occurrences; of equal ones the later."""
    g = found.groupBy("conv_id", "idx").agg(F.sum(occurrences(F.col("src"), F.col("en"))).alias("score"))
    return g.orderBy(F.desc("score"), F.desc("conv_id"), F.desc("idx")).limit(n)


# What stands over the locked and the other terms of a prompt.
LOCKED_HEAD = "=== THUẬT NGỮ KHÓA (BẮT BUỘC giữ nguyên bản dịch này, không được thay thế) ==="
TERMS_HEAD = "=== BẢNG THUẬT NGỮ (ưu tiên dùng bản dịch này) ==="


def prompts(found: DataFrame) -> DataFrame:
    """The capped terms of each chunk as a prompt's text: locked ones under a head of their own, both parts sorted by term."""
    pair = F.struct("en", F.concat(F.lit('  "'), "en", F.lit('" → "'), "vi", F.lit('"')).alias("line"))

    def part(locked: bool, head: str) -> Column:
        lines = F.array_sort(F.collect_list(F.when(F.col("locked") == locked, pair)))
        return F.when(F.size(lines) > 0, F.concat(F.lit(head + "\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")))

    text = F.concat(F.concat_ws("\n\n", part(True, LOCKED_HEAD), part(False, TERMS_HEAD)), F.lit("\n\n"))
    return capped(found).groupBy("conv_id", "idx").agg(F.count("*").alias("n_terms"), text.alias("prompt"))


def first_wins(layers: list[DataFrame]) -> DataFrame:
    """Union of (en, vi) layers in which, for each lower-cased term, the earliest layer counts."""
    every = reduce(DataFrame.unionByName, [d.select(F.lower(F.trim("en")).alias("en"), "vi", F.lit(i).alias("layer")) for i, d in enumerate(layers)])
    return every.groupBy("en").agg(F.min_by("vi", F.struct("layer", "vi")).alias("vi"), F.min("layer").alias("layer"))


def last_wins(layers: list[DataFrame]) -> DataFrame:
    """The overlay: for each term the latest layer counts."""
    n = len(layers) - 1
    return first_wins(layers[::-1]).withColumn("layer", n - F.col("layer"))


def merged(known: DataFrame, job: DataFrame) -> DataFrame:
    """The global terms (en, vi, field, frequency, confidence) after a job's (en, vi, field).

    New terms start at frequency 1 and confidence 0.5.  Agreement adds 1 and 0.1, at
    most 0.95; disagreement adds 1 while the frequency is under 3 and else changes nothing.
    What changes a term also gives it the job's field, cleaned, if it has none.  Blank
    terms and translations of the job are left out.
    """
    own = job.select(F.lower(T.strip(F.col("en"))).alias("en"), T.strip(F.col("vi")).alias("new_vi"), T.clean_field(F.col("field")).alias("new_field"))
    both = known.join(own.where("en <> '' and new_vi <> ''"), "en", "full_outer")
    same = F.lower(T.strip(F.col("vi"))) == F.lower("new_vi")
    new, seen = F.col("vi").isNull(), F.col("new_vi").isNotNull()
    changes = new | (seen & (same | (F.col("frequency") < 3)))
    freq = F.when(new, 1).when(changes, F.col("frequency") + 1).otherwise(F.col("frequency"))
    conf = F.when(new, 0.5).when(seen & same, F.least(F.lit(0.95), F.col("confidence") + 0.1)).otherwise(F.col("confidence"))
    field = F.when(changes, F.coalesce(F.nullif("field", F.lit("")), "new_field")).otherwise(F.col("field"))
    return both.select("en", F.coalesce("vi", "new_vi").alias("vi"), field.alias("field"), freq.cast("long").alias("frequency"), F.round(conf, 6).alias("confidence"))


def global_top(terms: DataFrame, min_confidence: float, min_frequency: int, limit: int, field: str | None = None) -> DataFrame:
    terms = terms.where(F.col("field") == field) if field else terms
    return terms.where((F.col("confidence") >= min_confidence) & (F.col("frequency") >= min_frequency)).orderBy(F.desc("frequency"), F.desc("confidence"), "en").limit(limit)


def _known(spark, d) -> DataFrame:
    t = V.terms(spark, d)
    return t.where("ordinal % 3 <> 0").select("en", "vi", F.when(F.col("ordinal") % 4 < 2, F.lit("curated")).alias("field"), (F.col("ordinal") % 5 + 1).alias("frequency"), (0.5 + (F.col("ordinal") % 5) * 0.1).alias("confidence"))


def _job(spark, d) -> DataFrame:
    return V.terms(spark, d).where("ordinal % 2 = 0").select("en", F.when(F.col("ordinal") % 4 == 0, F.upper("vi")).when(F.col("ordinal") % 14 == 0, F.lit(" ")).otherwise(F.concat("vi", F.lit("x"))).alias("vi"), F.when(F.col("ordinal") % 6 < 4, F.concat(F.lit(" field "), F.col("ordinal") % 6)).alias("field"))


def _found(spark, d) -> DataFrame:
    return matches(V.pairs(spark, d), V.terms(spark, d))


QUERIES = {
    "glossary_filter": lambda spark, d: capped(_found(spark, d)),
    "glossary_compliance": lambda spark, d: compliance(_found(spark, d)),
    "glossary_drift": lambda spark, d: drift(_found(spark, d)),
    "glossary_usage": lambda spark, d: usage(_found(spark, d)),
    "glossary_densest_chunks": lambda spark, d: densest_chunks(_found(spark, d)),
    "glossary_prompts": lambda spark, d: prompts(_found(spark, d)),
    "glossary_merge": lambda spark, d: merged(_known(spark, d), _job(spark, d)),
    "glossary_global_top": lambda spark, d: global_top(merged(_known(spark, d), _job(spark, d)), 0.6, 2, 20),
    "glossary_first_wins": lambda spark, d: first_wins([_known(spark, d), _job(spark, d)]),
    "glossary_last_wins": lambda spark, d: last_wins([_known(spark, d), _job(spark, d)]),
}

_F = f"f as (select p.*, t.* from {V.SQL_PAIRS} p join {V.SQL_TERMS} t on contains(lower(p.src), t.en))"
_CAP = f"{_F}, c as (select *, count(*) over w as n, row_number() over (w order by locked desc, length(en) desc, ordinal) as rank from f window w as (partition by conv_id, idx)), k as (select * from c where n <= 40 or locked or rank <= 40)"
_OCC = "((length(src) - length(replace(lower(src), en, ''))) / length(en))::bigint"
_KNOWN = f"known as (select en, vi, case when ordinal % 4 < 2 then 'curated' end as field, ordinal % 5 + 1 as frequency, 0.5 + (ordinal % 5) * 0.1 as confidence from {V.SQL_TERMS} where ordinal % 3 <> 0)"
_JOB = f"job as (select en, case when ordinal % 4 = 0 then upper(vi) when ordinal % 14 = 0 then ' ' else vi || 'x' end as vi, case when ordinal % 6 < 4 then ' field ' || ordinal % 6 end as field from {V.SQL_TERMS} where ordinal % 2 = 0)"
_MERGED = f"""{_KNOWN}, {_JOB}, m as (
  select coalesce(k.en, j.en) as en, coalesce(k.vi, j.vi) as vi,
    case when k.vi is null or (j.vi is not null and (lower(k.vi) = lower(j.vi) or frequency < 3)) then coalesce(k.field, left(trim(j.field), 64)) else k.field end as field,
    (case when k.vi is null then 1 when j.vi is not null and (lower(k.vi) = lower(j.vi) or frequency < 3) then frequency + 1 else frequency end)::bigint as frequency,
    round((case when k.vi is null then 0.5 when j.vi is not null and lower(k.vi) = lower(j.vi) then least(0.95, confidence + 0.1) else confidence end)::double, 6) as confidence
  from known k full join (select * from job where trim(vi) <> '') j on k.en = j.en)"""
ORACLE_SQL = {
    "glossary_filter": f"with {_CAP} select conv_id, idx, en, vi, locked, rank from k",
    "glossary_compliance": f"with {_F} select en, vi, count(*) as violations from f where trim(src) <> '' and trim(mt) <> '' and not contains(lower(mt), lower(vi)) group by 1, 2 having count(*) >= 3",
    "glossary_drift": f"""with {_F}, g as (select conv_id, en, ordinal, count(*) as n, list(idx order by idx) as chunks from f where contains(lower(mt), en) and not contains(lower(mt), lower(vi)) and mt <> '' group by 1, 2, 3 having count(*) >= 2),
h as (select *, count(*) over (partition by conv_id) as terms, row_number() over (partition by conv_id order by ordinal) as k from g)
select conv_id, en, n, chunks, round(least(0.85, 0.55 + terms * 0.06)::double, 6) as confidence from h where k <= 5""",
    "glossary_usage": f"with {_F} select en, sum({_OCC}) as occurrences, count(*) as chunks, round(coalesce(sum({_OCC}) filter (contains(lower(mt), lower(vi)) or contains(lower(mt), en)), 0)::double / sum({_OCC}), 6) as kept from f group by 1",
    "glossary_densest_chunks": f"with {_F} select conv_id, idx, sum({_OCC}) as score from f group by 1, 2 order by score desc, conv_id desc, idx desc limit 10",
    "glossary_prompts": f"""with {_CAP}, l as (select conv_id, idx, locked, en, '  "' || en || '" → "' || vi || '"' as line from k),
p as (select conv_id, idx, count(*) as n_terms, string_agg(line, chr(10) order by en) filter (locked) as a, string_agg(line, chr(10) order by en) filter (not locked) as b from l group by 1, 2)
select conv_id, idx, n_terms, concat_ws(chr(10) || chr(10), '{LOCKED_HEAD}' || chr(10) || a, '{TERMS_HEAD}' || chr(10) || b) || chr(10) || chr(10) as prompt from p""",
    "glossary_merge": f"with {_MERGED} select * from m",
    "glossary_global_top": f"with {_MERGED} select * from m where confidence >= 0.6 and frequency >= 2 order by frequency desc, confidence desc, en limit 20",
    "glossary_first_wins": f"with {_KNOWN}, {_JOB} select coalesce(k.en, j.en) as en, coalesce(k.vi, j.vi) as vi, case when k.en is null then 1 else 0 end as layer from known k full join job j on k.en = j.en",
    "glossary_last_wins": f"with {_KNOWN}, {_JOB} select coalesce(j.en, k.en) as en, coalesce(j.vi, k.vi) as vi, case when j.en is null then 0 else 1 end as layer from known k full join job j on k.en = j.en",
}
