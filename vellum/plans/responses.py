"""Reading model answers: fences, artefacts, JSON arrays, term lines, numbered replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import bound, strip

# How remarks of a chat begin, how prompts that are sent back begin, and hints of length that are.
REMARKS = ("Bạn có muốn", "Lưu ý", "Note:", "Chú ý:", "Would you", "Let me know", "Nếu bạn cần", "Hy vọng")
MORE_REMARKS = ("Tôi có thể hỗ trợ", "Tôi có thể giúp", "Nếu bạn muốn", "Hãy cho tôi biết", "If you")
TEXT_PROMPT = r"^(===\s*(QUY TẮC|NỘI DUNG CẦN DỊCH|VÍ DỤ)|Dịch các đoạn văn bản sau sang tiếng Việt)"
LATEX_PROMPT = r"^(===\s*(QUY TẮC|NỘI DUNG CẦN DỊCH|VÍ DỤ|BẢNG THUẬT NGỮ)|Dịch nội dung LaTeX sau sang tiếng Việt)"
LATEX_ECHO = "Dịch nội dung LaTeX sau sang tiếng Việt"
HINT = r"\s*\((?:table cell, |caption, )?max\s*~\s*\d+\s*chars?\)\s*"
ERRORS = "array<struct<index int, errors array<struct<category string, severity string>>, score double>>"
# Models in their order, and those of an empty choice.
KNOWN_MODELS = ("gemini", "chatgpt", "aistudio", "deepseek", "grok", "copilot")
DEFAULT_MODELS = ("gemini", "chatgpt")


def _begins(line: Column, words: tuple[str, ...]) -> Column:
    return strip(line).rlike("(?iu)^(" + "|".join(words) + ")")


def _to_last_text(lines: Column) -> Column:
    """Lines up to the last that isn't blank, joined."""
    last = F.array_max(F.transform(lines, lambda x, i: F.when(strip(x) != "", i + 1).otherwise(0)))
    return F.array_join(F.slice(lines, F.lit(1), F.coalesce(last, F.lit(0))), "\n")


def _before(lines: Column, bad) -> Column:
    """Lines before the first for which ``bad`` holds."""
    at = F.array_position(F.transform(lines, bad), F.lit(True))
    return F.when(at > 0, F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(lines)


def strip_artefacts(text: Column) -> Column:
    """Without the lines that begin as chat remarks do and without blank lines at the end; the lines after a remark stay."""
    return _to_last_text(F.filter(F.split(text, "\n"), lambda x: ~_begins(x, REMARKS + MORE_REMARKS)))


def text_of_answer(text: Column) -> Column:
    """The first fence of plain text, or else all; hints of length become a space; it ends before the first chat remark or echoed prompt."""
    fence = r"(?s)```(?:text)?\s*\n(.*?)```"
    inner = strip(F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text))
    lines = F.split(F.regexp_replace(inner, HINT, " "), "\n")
    return F.when(text == "", text).otherwise(_to_last_text(_before(lines, lambda x: _begins(x, REMARKS + MORE_REMARKS) | strip(x).rlike(TEXT_PROMPT))))


def latex_of_answer(text: Column) -> Column:
    """All fences of LaTeX, or else all; a first line ``code snippet`` goes; it ends before the first chat remark or echoed prompt, inside a line too."""
    fences = F.regexp_extract_all(text, F.lit(r"(?s)```(?:latex)?\s*\n(.*?)\n```"), F.lit(1))
    inner = F.when(F.size(fences) > 0, F.array_join(F.transform(fences, strip), "\n")).otherwise(strip(text))
    snippet = F.lower(inner).startswith("code snippet") & inner.contains("\n")
    inner = F.when(snippet, strip(F.regexp_replace(inner, r"^[^\n]*\n", ""))).otherwise(inner)
    lines = F.split(inner, "\n")
    # a line with the echo inside is kept up to it, if there is text before, and ends the answer
    over = lambda x: _begins(x, REMARKS) | strip(x).rlike(LATEX_PROMPT)
    at = F.array_position(F.transform(lines, lambda x: over(x) | x.contains(LATEX_ECHO)), F.lit(True)).cast("int")
    cut = F.get(lines, at - 1)
    head = F.when(~over(cut), F.rtrim(F.substring_index(cut, LATEX_ECHO, 1)))
    kept = F.concat(F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0))), F.when(F.coalesce(head, F.lit("")) != "", F.array(head)).otherwise(F.array().cast("array<string>")))
    return _to_last_text(F.when(at > 0, kept).otherwise(lines))


def fenced(text: Column) -> Column:
    """What a fence round the whole answer holds, or else all of it; null is empty."""
    bare = strip(text)
    lines = F.split(bare, r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]")
    n = F.size(lines)
    whole = bare.startswith("```") & (n >= 2) & F.ltrim(F.element_at(lines, -1)).startswith("```")
    return F.when(whole, strip(F.array_join(F.slice(lines, F.lit(2), F.greatest(n - 2, F.lit(0))), "\n"))).otherwise(bare)


def all_fenced(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(r"(?s)```[\w-]*\n?(.*?)```"), F.lit(1)), "\n")


MARKER = r"(?:^|\n)\s*\[(\d+)\]\s*"


def translated_blocks(answer: Column, sources: Column) -> Column:
    """The translations of a chunk's blocks, an array of texts, out of an answer ``[1] ... [2] ...``.

    A number stands at the start of a line.  One beyond the blocks is a citation and goes on
    the text of the highest block so far.  Chat remarks go from each text; of a number
    said twice the last text counts.  A block without a text keeps its source.  The answer
    to a single block may have no number.
    """
    numbers = F.regexp_extract_all(answer, F.lit(MARKER), F.lit(1))
    texts = F.slice(F.split(answer, MARKER), F.lit(2), F.greatest(F.size(numbers), F.lit(0)))
    pairs = F.zip_with(numbers, texts, lambda n, t: F.struct(n.alias("n"), n.try_cast("int").alias("k"), strip(t).alias("t")))

    def put(said: Column, p: Column) -> Column:
        own = p["k"].between(1, F.size(sources))
        last = F.array_max(F.map_keys(said))
        key = F.when(own, p["k"]).otherwise(last)
        more = F.concat(F.try_element_at(said, last), F.lit(" ["), F.coalesce(p["k"].cast("string"), p["n"]), F.lit("] "), p["t"])
        text = F.when(own, strip_artefacts(p["t"])).otherwise(more)
        return F.when(key.isNull(), said).otherwise(F.map_concat(F.map_filter(said, lambda k, _: k != key), F.create_map(F.coalesce(key, F.lit(0)), text)))

    said = F.aggregate(pairs, F.create_map().cast("map<int,string>"), put)
    alone = strip_artefacts(strip(answer))
    alone = F.when(F.lower(alone).startswith("plaintext"), strip(F.substring(alone, len("plaintext") + 1, 1 << 30))).otherwise(alone)
    said = F.when((F.size(said) == 0) & (F.size(sources) == 1), F.create_map(F.lit(1), alone)).otherwise(said)
    return bound(said, lambda m: F.transform(sources, lambda s, i: F.coalesce(F.nullif(F.try_element_at(m, i + 1), F.lit("")), s)))


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"</?(b|i|u|sup|sub)>", "")


def json_array(raw: Column) -> Column:
    """The array between the first [ and the last ], or null."""
    body = F.regexp_extract(raw, r"(?s)\[.*\]", 0)
    return F.from_json(F.when(body != "", body), ERRORS)


def json_value(text: Column) -> Column:
    """An answer as a variant: all of it, else the first fence marked as JSON, else the first fence, else from the first brace to the last; null if none is JSON."""
    whole = strip(text)
    tried = [whole, *(F.regexp_extract(whole, p, 1) for p in (r"(?s)```json\s*(.*?)\s*```", r"(?s)```\s*(.*?)\s*```", r"(?s)(\{.*\})"))]
    return F.coalesce(*(F.try_parse_json(F.nullif(x, F.lit(""))) for x in tried))


FAULTS = "struct<errors array<struct<category string, severity string, description string, source_span string, translation_span string, suggestion string>>>"


def critic_faults(raw: Column) -> Column:
    """The errors of a critic's answer, from its first brace to its last, as an array; what isn't said is accuracy, minor and empty."""
    said = F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")), FAULTS)["errors"]
    usual = {"category": "accuracy", "severity": "minor", "description": "", "source_span": "", "translation_span": "", "suggestion": ""}
    row = lambda e: F.struct(*(F.coalesce(e[k], F.lit(v)).alias(k) for k, v in usual.items()))
    return F.coalesce(F.transform(F.filter(said, lambda e: e.isNotNull()), row), F.array().cast("array<struct<category:string,severity:string,description:string,source_span:string,translation_span:string,suggestion:string>>"))


def merged_faults(found: DataFrame, answers: DataFrame, texts: DataFrame, least_words: int = 40) -> DataFrame:
    """(conv_id, idx, category, severity, source): rule errors (conv_id, idx, pos, category, severity) and those of answers (conv_id, idx, raw), each pair of category and severity once.

    Answers count for texts (conv_id, idx, src) of 40 words or more without a critical error.
    """
    keys = ["conv_id", "idx"]
    long_ = texts.where(F.size(F.filter(F.split("src", r"\s+"), lambda w: w != "")) >= least_words).select(*keys)
    open_ = answers.join(long_, keys, "left_semi").join(found.where("severity = 'critical'").select(*keys), keys, "left_anti")
    own = found.select(*keys, "category", "severity", F.lit("rules").alias("source"))
    said = open_.select(*keys, F.posexplode(critic_faults(F.col("raw"))).alias("pos", "e")).groupBy(*keys, "e.category", "e.severity").agg(F.min("pos").alias("pos")).drop("pos")
    return own.unionByName(said.join(own.select(*keys, "category", "severity"), [*keys, "category", "severity"], "left_anti").withColumn("source", F.lit("answer")))


def judge_scores(answers: DataFrame, weight) -> DataFrame:
    """(id, index, score) for each asked index: errors beat the stated score, which is taken as it is; what isn't answered is null, of several answers the last counts.

    ``answers`` has id, raw and asked (array of int); ``weight(category, severity)`` is a column.
    """
    said = answers.select("id", F.posexplode_outer(json_array(F.col("raw"))).alias("pos", "a")).where("a is not null")
    lost = F.aggregate(F.coalesce("a.errors", F.array().cast("array<struct<category string, severity string>>")), F.lit(0.0), lambda s, e: s + weight(e["category"], e["severity"]))
    score = F.when(F.col("a.errors").isNotNull(), F.bround(F.greatest(F.lit(0.0), 100 - lost), 1)).otherwise(F.col("a.score"))
    said = said.select("id", F.col("a.index").alias("index"), "pos", score.alias("score")).where("score is not null").groupBy("id", "index").agg(F.max_by("score", "pos").alias("score"))
    return answers.select("id", F.explode("asked").alias("index")).join(said, ["id", "index"], "left")


def term_lines(text: Column) -> Column:
    """``en -> vi -> field`` lines as an array of structs, lower-cased terms; later ones win when made a map."""
    parts = F.transform(F.filter(F.split(text, "\n"), lambda x: x.contains("→")), lambda x: F.split(x, "→"))
    row = F.transform(parts, lambda p: F.struct(F.lower(strip(p[0])).alias("en"), strip(p[1]).alias("vi"), F.left(F.nullif(strip(F.get(p, F.lit(2))), F.lit("")), F.lit(64)).alias("field")))
    return F.filter(row, lambda r: (r["en"] != "") & (r["vi"] != ""))


def strict_term_lines(text: Column, known: Column | None = None) -> Column:
    """``en → vi`` or ``en -> vi`` lines of the first fence (of none, plain text or a glossary), or else of all text, as (en, vi).

    Terms are lower-cased and lose quotes; of three characters or more, single words of five
    or more; no comments, and none of ``known``, an array of terms that have a translation
    already or keep their form.
    """
    inner = F.regexp_extract(text, r"(?s)```(?:glossary|text)?\s*\n(.*?)```", 1)
    lines = F.transform(F.split(strip(F.when(text.rlike(r"(?s)```(?:glossary|text)?\s*\n.*?```"), inner).otherwise(text)), "\n"), strip)
    pair = r"^(.+?)\s*(?:→|->)\s*(.+)$"
    bare = lambda x: F.regexp_replace(strip(x), r"^[\"']+|[\"']+$", "")
    rows = F.transform(F.filter(lines, lambda x: ~x.startswith("#") & x.rlike(pair)), lambda x: F.struct(F.lower(bare(F.regexp_extract(x, pair, 1))).alias("en"), bare(F.regexp_extract(x, pair, 2)).alias("vi")))
    good = lambda r: (F.length(r["en"]) >= 3) & (r["en"].contains(" ") | (F.length(r["en"]) >= 5)) & (r["vi"] != "")
    return F.filter(rows, lambda r: good(r) if known is None else good(r) & ~F.array_contains(known, r["en"]))


def numbered(text: Column) -> Column:
    """``[3] reply`` parts as (index, reply)."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)\[(\d+)\]\s*(.*?)(?=\n\s*\[\d+\]|\z)"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^\[(\d+)\]", 1).cast("int").alias("index"), strip(F.regexp_replace(x, r"^\[\d+\]\s*", "")).alias("reply")))


def filled(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """``blocks`` (doc_id, index, mt) where empty translations take the reply of their number."""
    got = replies.select("doc_id", F.explode(numbered(F.col("text"))).alias("r")).select("doc_id", "r.index", "r.reply").groupBy("doc_id", "index").agg(F.first("reply").alias("reply"))
    return blocks.join(got, ["doc_id", "index"], "left").withColumn("mt", F.when(F.coalesce("mt", F.lit("")) == "", F.coalesce("reply", F.lit(""))).otherwise(F.col("mt"))).drop("reply")


def guarded_fix(blocks: DataFrame, fixes: DataFrame, accept) -> DataFrame:
    """``blocks`` updated by ``fixes`` (doc_id, index, fix) where the fix isn't blank, changes something and ``accept(fix)`` holds."""
    j = blocks.join(fixes, ["doc_id", "index"], "left")
    good = (strip(F.col("fix")) != "") & (F.col("fix") != F.col("mt")) & accept(F.col("fix"))
    return j.withColumn("mt", F.when(good, F.col("fix")).otherwise(F.col("mt"))).drop("fix")


def normalised_score(raw: Column) -> Column:
    """Scores up to 1 are shares; clamped to 0..100, other text is null."""
    x = raw.try_cast("double")
    return F.when(x.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.when(x <= 1, x * 100).otherwise(x))))


def clamped_tabs(n: Column) -> Column:
    i = n.try_cast("int")
    return F.when(i.isNull(), 2).otherwise(F.least(F.lit(6), F.greatest(F.lit(1), i)))


def model_preference(value: Column) -> Column:
    """Known models of a JSON list or a separated string, in order and once, letter case aside; the usual two if none is left, or for other JSON."""
    known, usual = F.array(*map(F.lit, KNOWN_MODELS)), F.array(*map(F.lit, DEFAULT_MODELS))
    text = strip(value)
    parsed = F.try_parse_json(F.nullif(text, F.lit("")))
    listed = F.schema_of_variant(parsed).startswith("ARRAY")
    given = F.when(parsed.isNull(), F.split(text, r"[,;\s]+")).when(listed, F.from_json(text, "array<string>"))
    kept = F.array_distinct(F.filter(F.transform(given, lambda m: F.lower(strip(m))), lambda m: F.array_contains(known, m)))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) <= 0, usual).otherwise(kept)


def execution_order(models: Column) -> Column:
    """A single model is followed by the others."""
    known = F.array(*map(F.lit, KNOWN_MODELS))
    return F.when(F.size(models) == 1, F.concat(models, F.array_except(known, models))).otherwise(models)


def judge_backend(translator: Column, preferred: Column) -> Column:
    """The preferred model if it is known and another than the translator, else the first other one."""
    known = F.array(*map(F.lit, KNOWN_MODELS))
    other = F.filter(known, lambda m: m != translator)
    return F.when(F.array_contains(known, preferred) & (preferred != translator), preferred).otherwise(F.element_at(other, 1))
