"""Heuristic quality of parallel text: scores, issues, document metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.sources import views as V

PENALTY = {"error": 30, "warning": 10, "info": 2}


def issues(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Each non-blank block with its checks: weight, untranslated severity, length and number issues."""
    src, mt = F.col("s"), F.col("t")
    checked = rows.select(key, "idx", T.strip(F.col("src")).alias("s"), T.strip(F.col("mt")).alias("t")).where("s <> ''")
    bad = T.untranslated(src, mt)
    ratio = F.length(mt) / F.length(src)
    checked = checked.withColumn("severity", F.when(bad, T.untranslated_severity(src)))
    ok = F.col("severity").isNull()
    length = F.when(ok & (F.length(src) > 30), F.when(ratio < 0.3, 15).when(ratio > 3.0, 10))
    numbers = ok & (F.length(src) > 20) & (F.size(T.numbers_missing(src, mt)) > 0)
    return checked.select(key, "idx", "severity", length.alias("length_penalty"), numbers.alias("numbers"), F.length(src).alias("n_chars"))


def quality_scores(rows: DataFrame, glossary_issues: DataFrame | None = None, key: str = "conv_id") -> DataFrame:
    """One row for each document: blocks, untranslated and translated blocks, issues by severity, score of 100.

    Penalties are weighted by a block's share of the document's characters; each
    glossary issue (``key``, n) costs half a point.
    """
    each = issues(rows, key)
    flat = F.when(F.col("severity").isNotNull(), F.element_at(F.create_map(*[F.lit(x) for kv in PENALTY.items() for x in kv]), F.col("severity"))).otherwise(F.lit(0)) + F.coalesce("length_penalty", F.lit(0)) + F.when(F.col("numbers"), 5).otherwise(0)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = each.groupBy(key).agg(
        F.sum(flat * F.col("n_chars")).alias("penalty"),
        F.sum("n_chars").alias("n_chars"),
        one(F.col("severity").isNotNull()).alias("untranslated_blocks"),
        one(F.col("severity").isNull()).alias("translated_blocks"),
        one(F.col("severity") == "error").alias("errors"),
        (one(F.col("severity") == "warning") + one(F.col("length_penalty").isNotNull()) + one(F.col("numbers"))).alias("warnings"),
        one(F.col("severity") == "info").alias("infos"),
    )
    out = rows.groupBy(key).agg(F.count("*").alias("total_blocks")).join(sums, key, "left")
    cost = F.coalesce(F.col("penalty") / F.col("n_chars"), F.lit(0.0))
    if glossary_issues is not None:
        out = out.join(glossary_issues, key, "left")
        cost = cost + F.coalesce("n", F.lit(0)) * 0.5
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("untranslated_blocks", "translated_blocks", "errors", "warnings", "infos")]
    return out.select(key, "total_blocks", *counts, F.round(F.greatest(F.lit(0.0), 100 - cost), 6).alias("score"))


def category_counts(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Issues by category and severity over all documents."""
    each = issues(rows, key)
    kinds = F.array(
        F.when(F.col("severity").isNotNull(), F.struct(F.lit("untranslated").alias("category"), F.col("severity"))),
        F.when(F.col("length_penalty").isNotNull(), F.struct(F.lit("length").alias("category"), F.lit("warning").alias("severity"))),
        F.when(F.col("numbers"), F.struct(F.lit("numbers").alias("category"), F.lit("warning").alias("severity"))),
    )
    return each.select(F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("i")).groupBy("i.category", "i.severity").agg(F.count("*").alias("n"))


def fixable(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Blocks worth translating again, with the reason."""
    src, mt = F.col("s"), F.col("t")
    each = rows.select(key, "idx", T.strip(F.col("src")).alias("s"), T.strip(F.col("mt")).alias("t")).where("s <> ''")
    each = each.where((T.n_tokens(src) >= 8) & ~T.is_metadata(src) & (T.letters(src) / F.length(src) >= 0.3))
    reason = F.when(mt == "", "empty").when(T.untranslated(src, mt), "untranslated").when((F.length(src) > 30) & (F.length(mt) / F.length(src) < 0.3), "truncated")
    return each.select(key, "idx", reason.alias("reason")).where("reason is not null")


def predicates(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Text predicates of each pair side by side."""
    src, mt = F.col("src"), F.col("mt")
    return rows.select(
        key, "idx",
        T.has_vietnamese(mt).alias("has_vietnamese"), F.round(T.english_ratio(mt), 6).alias("english_ratio"),
        F.round(T.english_ratio(mt, 3), 6).alias("english_ratio_3"), F.round(T.ratio(T.vietnamese_chars(mt), T.letters(mt)), 6).alias("vi_ratio"),
        T.english_heavy(mt).alias("english_heavy"), T.truncated(src, mt).alias("truncated"), T.response_truncated(src, mt).alias("response_truncated"),
        T.ends_at_sentence(mt).alias("ends_at_sentence"), F.size(F.array_distinct(T.found(mt, r"[0-9]+(?:[.,][0-9]+)*"))).alias("n_numbers"),
        (F.length(src) > 40).__and__(F.length(mt) > 0).__and__(F.length(mt) / F.length(src) < 0.6).alias("over_compressed"),
    )


# ---- document metrics ---------------------------------------------------------------


def _sub_scores(rows: DataFrame, key: str) -> DataFrame:
    s, t = F.col("s"), F.col("t")
    each = rows.select(key, T.strip(F.col("src")).alias("s"), T.strip(F.col("mt")).alias("t"))
    # the translation is searched once for a row, and only if the source has any
    kept = lambda p: F.when(s.rlike(p), T.bound(F.array_distinct(T.found(t, p)), lambda there: F.size(F.filter(T.found(s, p), lambda x: F.array_contains(there, x))))).otherwise(0)
    both = (s != "") & (t != "")
    ratio = F.when((F.length(s) >= 20) & (t != ""), F.length(t) / F.length(s))
    each = each.select(
        key, (s != "").cast("int").alias("has_src"), ((s != "") & T.has_vietnamese(t)).cast("int").alias("done"),
        T.letters(t).alias("alpha"), T.vietnamese_chars(t).alias("vi"), T.n_tokens(t).alias("words"), T.function_words(t).alias("fw"),
        F.when(both, F.size(T.found(s, T.NUMBER))).otherwise(0).alias("nums"), F.when(both, kept(T.NUMBER)).otherwise(0).alias("nums_kept"),
        F.when(both, F.size(T.found(s, T.MATH_CLASS))).otherwise(0).alias("syms"), F.when(both, kept(T.MATH_CLASS)).otherwise(0).alias("syms_kept"),
        ratio.alias("ratio"),
    )
    total = {c: F.sum(c).alias(c) for c in ("has_src", "done", "alpha", "vi", "words", "fw", "nums", "nums_kept", "syms", "syms_kept")}
    return each.groupBy(key).agg(*total.values(), F.count("ratio").alias("n"), F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("std"), F.sum(F.when((F.col("ratio") < 0.3) | (F.col("ratio") > 3.0), 1).otherwise(0)).alias("outliers"))


#: Two capitalised words or more.
TERM = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"


def terminology(rows: DataFrame, key: str) -> DataFrame:
    """(key, terms_checked, terms_consistent): capitalised terms in two blocks or more whose translations share enough words."""
    each = rows.select(key, T.strip(F.col("src")).alias("s"), T.strip(F.col("mt")).alias("t")).where("s <> '' and t <> ''").where(F.col("s").rlike(TERM))
    words = F.array_distinct(T.tokens(F.lower(F.col("t"))))
    found = each.select(key, F.explode(T.found(F.col("s"), TERM)).alias("term"), words.alias("words")).withColumn("term", F.lower("term"))
    n = found.groupBy(key, "term").agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avg_len"))
    common = found.select(key, "term", F.explode("words").alias("w")).groupBy(key, "term", "w").agg(F.count("*").alias("has"))
    shared = common.join(n.where("n >= 2"), [key, "term"]).groupBy(key, "term").agg(F.sum((F.col("has") == F.col("n")).cast("int")).alias("shared"), F.first("avg_len").alias("avg_len"))
    return shared.groupBy(key).agg(F.count("*").alias("terms_checked"), F.sum((F.col("shared") / F.col("avg_len") > 0.3).cast("int")).alias("terms_consistent"))


def fluency(rows: DataFrame, key: str) -> DataFrame:
    """(key, avg_sentence, fluency) over sentences of three words or more."""
    parts = rows.select(key, F.explode(F.split(T.strip(F.col("mt")), r"[.!?]\s+")).alias("s"))
    parts = parts.select(key, T.n_tokens(F.col("s")).alias("n"), T.function_words(F.col("s")).alias("fw"), T.english_words(F.col("s")).alias("en")).where("n >= 3")
    g = parts.groupBy(key).agg(F.avg("n").alias("avg_sentence"), F.sum("n").alias("words"), F.sum("fw").alias("fw"), F.avg(((F.col("n") > 5) & (F.col("en") / F.col("n") > 0.7)).cast("int")).alias("heavy"))
    a, fw = F.col("avg_sentence"), F.col("fw") / F.col("words")
    score = 100 - F.when(a < 8, (8 - a) * 3).when(a > 40, (a - 40) * 2).otherwise(0.0) - F.when(fw < 0.05, 30.0).when(fw < 0.1, 15.0).otherwise(0.0) - F.col("heavy") * 40
    return g.select(key, "avg_sentence", F.greatest(F.lit(0.0), score).alias("fluency"))


WEIGHTS = {"coverage": 0.25, "vietnamese": 0.25, "math": 0.15, "length": 0.10, "terminology": 0.10, "fluency": 0.15}


def metrics(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Six sub-scores and their weighted sum for each document."""
    g = _sub_scores(rows, key).join(terminology(rows, key), key, "left").join(fluency(rows, key), key, "left")
    c = F.col
    vi = F.when(c("alpha") == 0, 0.0).otherwise(F.least(F.lit(100.0), (c("vi") / c("alpha") * 0.4 + F.least(F.least(F.lit(1.0), c("fw") / c("words")) * 5, F.lit(0.6))) * 100))
    share = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(1.0)
    off = F.when(c("mean") < 0.8, (0.8 - c("mean")) * 50).when(c("mean") > 1.5, (c("mean") - 1.5) * 30).otherwise(0.0)
    length = F.when(c("n") == 0, 100.0).otherwise(F.greatest(F.lit(0.0), 100 - off - F.least(F.lit(30.0), c("std") * 40) - c("outliers") / c("n") * 40))
    scores: dict[str, Column] = {
        "coverage": F.when(c("has_src") == 0, 100.0).otherwise(c("done") / c("has_src") * 100),
        "vietnamese": vi,
        "math": (share("nums_kept", "nums") * 0.7 + share("syms_kept", "syms") * 0.3) * 100,
        "length": length,
        "terminology": F.coalesce(c("terms_consistent") / c("terms_checked"), F.lit(1.0)) * 100,
        "fluency": F.coalesce("fluency", F.lit(100.0)),
    }
    overall = sum((v * WEIGHTS[k] for k, v in scores.items()), F.lit(0.0))
    return g.select(key, *(F.round(v, 6).alias(f"{k}_score") for k, v in scores.items()), F.round(overall, 6).alias("overall"))


# ---- registered queries ---------------------------------------------------------------

QUERIES = {
    "quality_score": lambda spark, d: quality_scores(V.pairs(spark, d)),
    "quality_categories": lambda spark, d: category_counts(V.pairs(spark, d)),
    "fixable_blocks": lambda spark, d: fixable(V.pairs(spark, d)),
    "text_predicates": lambda spark, d: predicates(V.pairs(spark, d)),
    "translation_metrics": lambda spark, d: metrics(V.pairs(spark, d)),
}

_S, _T = T.sql_strip("src"), T.sql_strip("mt")
_ISSUES = f"""
  select conv_id, idx, s, t, length(s) as n_chars, severity,
    case when severity is null and length(s) > 30 then case when length(t)::double / length(s) < 0.3 then 15 when length(t)::double / length(s) > 3.0 then 10 end end as lp,
    severity is null and length(s) > 20 and len(list_filter(regexp_extract_all(s, '[0-9]+\\.?[0-9]*'), lambda n: length(n) > 1 and not list_contains(regexp_extract_all(t, '[0-9]+\\.?[0-9]*'), n))) > 0 as numbers
  from (select *, case when {T.sql_untranslated("s", "t")} then {T.sql_severity("s")} end as severity
        from (select conv_id, idx, {_S} as s, {_T} as t from {V.SQL_PAIRS}) where s <> '')"""
_NUM, _SYM = T.NUMBER, f"[{T.MATH_SYMBOLS}]"
_KEPT = lambda p: f"len(list_filter(regexp_extract_all(s, '{p}'), lambda x: list_contains(regexp_extract_all(t, '{p}'), x)))"

ORACLE_SQL = {
    "quality_score": f"""
with i as ({_ISSUES}), g as (
  select conv_id, sum((case severity when 'error' then 30 when 'warning' then 10 when 'info' then 2 else 0 end + coalesce(lp, 0) + case when numbers then 5 else 0 end) * n_chars)::double / sum(n_chars) as cost,
    count(severity) as u, count(*) - count(severity) as t, count(*) filter (severity = 'error') as e,
    count(*) filter (severity = 'warning') + count(lp) + count(*) filter (numbers) as w, count(*) filter (severity = 'info') as f from i group by 1)
select conv_id, total_blocks, coalesce(u, 0) as untranslated_blocks, coalesce(t, 0) as translated_blocks, coalesce(e, 0) as errors, coalesce(w, 0) as warnings, coalesce(f, 0) as infos,
  round(greatest(0.0, 100 - coalesce(cost, 0)), 6) as score
from (select conv_id, count(*) as total_blocks from {V.SQL_PAIRS} group by 1) left join g using (conv_id)""",
    "quality_categories": f"""
with i as ({_ISSUES})
select category, severity, count(*) as n from (
  select 'untranslated' as category, severity from i where severity is not null
  union all select 'length', 'warning' from i where lp is not null
  union all select 'numbers', 'warning' from i where numbers) group by 1, 2""",
    "fixable_blocks": f"""
select * from (
  select conv_id, idx, case when t = '' then 'empty' when {T.sql_untranslated("s", "t")} then 'untranslated' when length(s) > 30 and length(t)::double / length(s) < 0.3 then 'truncated' end as reason
  from (select conv_id, idx, {_S} as s, {_T} as t from {V.SQL_PAIRS})
  where s <> '' and {T.sql_count("s", T.TOKEN)} >= 8 and not regexp_matches(s, '{T.METADATA}') and {T.sql_count("s", chr(92) + "p{L}")}::double / length(s) >= 0.3) where reason is not null""",
    "text_predicates": f"""
select conv_id, idx, regexp_matches(mt, '[{T.VIETNAMESE}]') as has_vietnamese,
  round({T.sql_ratio(T.sql_english("mt"), T.sql_count("mt", T.TOKEN))}, 6) as english_ratio, round({T.sql_ratio(T.sql_english("mt", 3), T.sql_count("mt", T.TOKEN))}, 6) as english_ratio_3,
  round({T.sql_ratio(T.sql_count("mt", f"[{T.VIETNAMESE}]"), T.sql_count("mt", chr(92) + "p{L}"))}, 6) as vi_ratio,
  length({_T}) >= 20 and {T.sql_english("mt")} >= 5 and {T.sql_count("lower(mt)", f"[{T.VIETNAMESE}]")} < {T.sql_english("mt")} * 0.5 as english_heavy,
  length(src) >= 200 and (mt = '' or length(mt) < length(src) * 0.3) as truncated,
  {_T} = '' or (length({_S}) > 200 and length({_T}) < length({_S}) * 0.3) as response_truncated,
  mt = '' or regexp_matches(regexp_replace(mt, '[{T.SPACE}]+$', ''), '[.!?;:]\\s*[")]?$') as ends_at_sentence,
  len(list_distinct(regexp_extract_all(mt, '[0-9]+(?:[.,][0-9]+)*'))) as n_numbers,
  length(src) > 40 and length(mt) > 0 and length(mt)::double / length(src) < 0.6 as over_compressed
from {V.SQL_PAIRS}""",
    "translation_metrics": f"""
with p as (select conv_id, {_S} as s, {_T} as t from {V.SQL_PAIRS}),
e as (select conv_id, (s <> '')::int as has_src, (s <> '' and regexp_matches(t, '[{T.VIETNAMESE}]'))::int as done, {T.sql_count("t", chr(92) + "p{L}")} as alpha,
  {T.sql_count("t", f"[{T.VIETNAMESE}]")} as vi, {T.sql_count("t", T.TOKEN)} as words, {T.sql_function_words("t")} as fw,
  case when s <> '' and t <> '' then {T.sql_count("s", _NUM)} else 0 end as nums, case when s <> '' and t <> '' then {_KEPT(_NUM)} else 0 end as nums_kept,
  case when s <> '' and t <> '' then {T.sql_count("s", _SYM)} else 0 end as syms, case when s <> '' and t <> '' then {_KEPT(_SYM)} else 0 end as syms_kept,
  case when length(s) >= 20 and t <> '' then length(t)::double / length(s) end as ratio from p),
g as (select conv_id, sum(has_src) as has_src, sum(done) as done, sum(alpha) as alpha, sum(vi) as vi, sum(words) as words, sum(fw) as fw, sum(nums) as nums, sum(nums_kept) as nums_kept,
  sum(syms) as syms, sum(syms_kept) as syms_kept, count(ratio) as n, avg(ratio) as mean, stddev_pop(ratio) as std, count(*) filter (ratio < 0.3 or ratio > 3.0) as outliers from e group by 1),
tf as (select conv_id, lower(unnest(regexp_extract_all(s, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b'))) as term, list_distinct({T.sql_tokens("lower(t)")}) as words from p where s <> '' and t <> ''),
tn as (select conv_id, term, count(*) as n, avg(len(words)) as avg_len from tf group by 1, 2 having count(*) >= 2),
tc as (select conv_id, term, w, count(*) as has from (select conv_id, term, unnest(words) as w from tf) group by all),
ts as (select conv_id, term, count(*) filter (has = n) as shared, any_value(avg_len) as avg_len from tc join tn using (conv_id, term) group by 1, 2),
te as (select conv_id, count(*) as checked, count(*) filter (shared::double / avg_len > 0.3) as consistent from ts group by 1),
fs as (select conv_id, {T.sql_count("s", T.TOKEN)} as n, {T.sql_function_words("s")} as fw, {T.sql_english("s")} as en from (select conv_id, unnest(regexp_split_to_array(t, '[.!?]\\s+')) as s from p)),
fg as (select conv_id, avg(n) as a, sum(fw)::double / sum(n) as fw, avg(case when n > 5 and en::double / n > 0.7 then 1 else 0 end) as heavy from fs where n >= 3 group by 1),
f as (select conv_id, greatest(0.0, 100 - case when a < 8 then (8 - a) * 3 when a > 40 then (a - 40) * 2 else 0 end - case when fw < 0.05 then 30 when fw < 0.1 then 15 else 0 end - heavy * 40) as fluency from fg),
x as (select conv_id, case when has_src = 0 then 100.0 else done * 100.0::double / has_src end as coverage,
  case when alpha = 0 then 0.0 else least(100.0, (vi::double / alpha * 0.4 + least(least(1.0, fw::double / words) * 5, 0.6)) * 100) end as vietnamese,
  (case when nums > 0 then nums_kept::double / nums else 1 end * 0.7 + case when syms > 0 then syms_kept::double / syms else 1 end * 0.3) * 100 as math,
  case when n = 0 then 100.0 else greatest(0.0, 100 - case when mean < 0.8 then (0.8 - mean) * 50 when mean > 1.5 then (mean - 1.5) * 30 else 0 end - least(30.0, std * 40) - outliers::double / n * 40) end as length,
  coalesce(consistent::double / checked, 1.0) * 100 as terminology, coalesce(fluency, 100.0) as fluency
  from g left join te using (conv_id) left join f using (conv_id))
select conv_id, round(coverage, 6) as coverage_score, round(vietnamese, 6) as vietnamese_score, round(math, 6) as math_score, round(length, 6) as length_score, round(terminology, 6) as terminology_score,
  round(fluency, 6) as fluency_score, round(coverage * 0.25 + vietnamese * 0.25 + math * 0.15 + length * 0.10 + terminology * 0.10 + fluency * 0.15, 6) as overall from x""",
}
