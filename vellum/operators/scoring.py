"""n-gram agreement, critic errors and error-weighted scores of pairs."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from vellum.functions import text as T
from vellum.operators import glossary
from vellum.sources import views as V

CHAR_ORDERS, WORD_ORDERS = 6, 2
#: White space as the column functions see it.
WHITE = "[\\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

# Weights of an error by category, for minor, major and critical.
MQM_WEIGHTS = {"accuracy": (1, 5, 25), "fluency": (0.1, 1, 5), "terminology": (0.1, 1, 5), "style": (0.1, 0.5, 2), "locale": (0.1, 0.5, 2)}
SEVERITY_RANK = {"minor": 1, "major": 2, "critical": 3}


def _overlaps(a: list, b: list, n: int) -> tuple[int, int, int]:
    """(n-grams of a, of b, in both with repeats)."""
    grams = lambda x: Counter(zip(*(x[i:] for i in range(n)), strict=False))
    ga, gb = grams(a), grams(b)
    return max(0, len(a) - n + 1), max(0, len(b) - n + 1), sum((ga & gb).values())


_OVERLAP = S.StructType([S.StructField("kind", S.StringType()), *(S.StructField(f, S.LongType()) for f in ("total_h", "total_r", "matched"))])


@F.pandas_udf(S.ArrayType(_OVERLAP))
def overlaps(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """Overlaps of every order of one pair; within the row, so nothing is shuffled."""
    split = re.compile(WHITE).split

    def one(h: str, r: str) -> list[tuple]:
        words = [[w for w in split(x) if w] for x in (h, r)]
        chars = [list(x.replace(" ", "▁")) for x in (h, r)]
        return [(f"c{n}", *_overlaps(*chars, n)) for n in range(1, CHAR_ORDERS + 1)] + [(f"w{n}", *_overlaps(*words, n)) for n in range(1, WORD_ORDERS + 1)]

    return pd.Series([one(h, r) for h, r in zip(hyp, ref, strict=True)])


def ngram_matches(rows: DataFrame) -> DataFrame:
    """(conv_id, idx, kind, total_h, total_r, matched) of mt against src for each order, c1 to c6 and w1, w2."""
    return rows.select("conv_id", "idx", F.inline(overlaps("mt", "src")))


def _f(m: Column, h: Column, r: Column, beta: float = 1.0) -> Column:
    """F of matched over both totals, recall weighing ``beta`` times as much: 2m / (h + r) for 1."""
    return F.when((m > 0) & (h > 0) & (r > 0), (1 + beta**2) * m / (h + beta**2 * r)).otherwise(0.0)


def chrf(rows: DataFrame, beta: float = 1.0) -> DataFrame:
    """Both sentence scores of each pair: chrf counts empty orders as 0, agreement leaves them out, has no words and weighs both sides alike.  All within the row."""
    out = rows.select("conv_id", "idx", "mt", "src", overlaps("mt", "src").alias("o"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    f = F.transform("o", lambda x: _f(x["matched"], x["total_h"], x["total_r"], beta))
    char = F.filter("o", lambda x: x["kind"].startswith("c"))
    n = F.size(F.filter(char, lambda x: x["matched"] > 0))
    blank = (T.strip(F.col("mt")) == "") | (T.strip(F.col("src")) == "")
    score = F.when(blank, 0.0).otherwise(add(f) / (CHAR_ORDERS + WORD_ORDERS) * 100)
    agreement = F.when(n > 0, add(F.transform(char, lambda x: _f(x["matched"], x["total_h"], x["total_r"]))) / n * 100).otherwise(0.0)
    return out.select("conv_id", "idx", F.round(score, 6).alias("chrf"), F.round(agreement, 6).alias("agreement"))


def band(score: Column) -> Column:
    return F.when(score >= 70, "excellent").when(score >= 55, "good").when(score >= 40, "fair").when(score >= 25, "poor").otherwise("bad")


def f1_band(f1: Column) -> Column:
    """Five bands of a semantic F1 score."""
    return F.when(f1 >= 0.92, "excellent").when(f1 >= 0.87, "good").when(f1 >= 0.80, "fair").when(f1 >= 0.70, "middling").otherwise("low")


def semantic_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """(conv_id, idx, f1, band) of pairs that have a translation and a score (conv_id, idx, f1) against their reference."""
    j = rows.where(T.strip(F.col("mt")) != "").join(scores.select("conv_id", "idx", "f1"), ["conv_id", "idx"])
    return j.select("conv_id", "idx", "f1", f1_band(F.col("f1")).alias("band"))


def corpus_chrf(rows: DataFrame) -> DataFrame:
    """Mean of the sentence scores of each conversation, its band and how many are under 40."""
    return chrf(rows).groupBy("conv_id").agg(F.count("*").alias("segments"), F.round(F.avg("chrf"), 5).alias("corpus_chrf"), band(F.avg("chrf")).alias("band"), F.sum((F.col("chrf") < 40).cast("int")).alias("low_segments"))


def verdict(agreement: Column, has_second: Column) -> Column:
    return F.when(~has_second, "consensus").when(agreement >= 65, "consensus").when(agreement >= 40, "mild").otherwise("synthesized")


def agreement_histogram(rows: DataFrame) -> DataFrame:
    """Ten buckets of agreement, empty ones included, with the verdicts in each."""
    a = chrf(rows).join(rows.select("conv_id", "idx", (T.strip(F.col("mt")) != "").alias("second")), ["conv_id", "idx"])
    score = F.when(F.col("second"), F.col("agreement")).otherwise(0.0)
    a = a.select(F.least(F.lit(9), F.floor(score / 10)).cast("long").alias("bucket"), verdict(score, F.col("second")).alias("v"))
    n = lambda v: F.sum((F.col("v") == v).cast("int")).alias(v)
    g = a.groupBy("bucket").agg(F.count("*").alias("n"), n("consensus"), n("mild"), n("synthesized"))
    every = rows.sparkSession.range(10).withColumnRenamed("id", "bucket")
    return every.join(g, "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "consensus", "mild", "synthesized")))


def critic_errors(rows: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(conv_id, idx, pos, category, severity): what rules find wrong with each pair, in a fixed order.

    With ``terms`` (en, vi), a pair whose source has a term but whose translation lacks
    its translation has one minor error of terminology.
    """
    s, t = F.col("s"), F.col("t")
    each = rows.select("conv_id", "idx", T.strip(F.col("src")).alias("s"), T.strip(F.col("mt")).alias("t")).where("s <> ''")
    if terms is None:
        each = each.withColumn("astray", F.lit(False))
    else:
        off = glossary.matches(rows.select("conv_id", "idx", "src", "mt"), terms.select("en", "vi")).where(~F.contains(F.lower("mt"), F.lower("vi")))
        each = each.join(off.select("conv_id", "idx").distinct().withColumn("astray", F.lit(True)), ["conv_id", "idx"], "left")
    error = lambda when, cat, sev: F.when(when, F.struct(F.lit(cat).alias("category"), F.lit(sev).alias("severity")))
    blank = t == ""
    ratio = F.length(t) / F.length(s)
    number = r"[0-9]+(?:[.,][0-9]+)*"
    lost = F.size(F.filter(F.array_except(T.found(s, number), T.found(t, number)), lambda n: F.length(n) > 1)) > 0
    vi = T.vietnamese_chars(t) / F.greatest(T.letters(t), F.lit(1))
    english = (vi < 0.05) & (T.english_ratio(t, 3) > 0.5) & (T.english_ratio(s, 3) > 0.4) & (T.n_tokens(s) >= 8)
    found = F.array(
        error(blank, "completeness", "critical"),
        error(~blank & english, "accuracy", "critical"),
        error(~blank & (ratio < 0.3) & (F.length(s) > 50), "completeness", "major"),
        error(~blank & (ratio > 3.5) & (F.length(s) > 30), "fluency", "major"),
        error(~blank & lost, "accuracy", "minor"),
        error(~blank & F.coalesce("astray", F.lit(False)), "terminology", "minor"),
    )
    return each.select("conv_id", "idx", F.posexplode(F.filter(found, lambda x: x.isNotNull())).alias("pos", "e")).select("conv_id", "idx", "pos", "e.*")


def error_weight(category: Column, severity: Column) -> Column:
    """Unknown categories count as accuracy, unknown severities as 1."""
    out = F.lit(1.0)
    for k, weights in MQM_WEIGHTS.items():
        known = F.lit(True) if k == "accuracy" else category == k
        if k == "accuracy":
            known = ~category.isin(*(c for c in MQM_WEIGHTS if c != "accuracy"))
        for sev, w in zip(SEVERITY_RANK, weights, strict=True):
            out = F.when(known & (severity == sev), F.lit(float(w))).otherwise(out)
    return out


def mqm(rows: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Error-weighted score of each pair, its worst severity and number of errors."""
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "major", 2).otherwise(1)
    g = critic_errors(rows, terms).groupBy("conv_id", "idx").agg(F.sum(error_weight(F.col("category"), F.col("severity"))).alias("w"), F.count("*").alias("n"), F.max_by("severity", F.struct(rank, -F.col("pos"))).alias("worst"))
    out = rows.select("conv_id", "idx").join(g, ["conv_id", "idx"], "left")
    return out.select("conv_id", "idx", F.round(F.greatest(F.lit(0.0), 100 - F.coalesce("w", F.lit(0.0))), 6).alias("mqm"), F.coalesce("worst", F.lit("none")).alias("worst"), F.coalesce("n", F.lit(0)).cast("long").alias("n_errors"))


def judge_summary(rows: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Per conversation: judged pairs, mean score rounded half to even, and those under the pass mark of 70."""
    return mqm(rows, terms).groupBy("conv_id").agg(F.count("*").alias("judged"), F.bround(F.avg("mqm")).cast("long").alias("avg_score"), F.sum((F.col("mqm") < 70).cast("int")).alias("flagged"), F.sum("n_errors").alias("n_errors"))


QUERIES = {
    "chrf_segments": lambda spark, d: chrf(V.pairs(spark, d)),
    "chrf_corpus": lambda spark, d: corpus_chrf(V.pairs(spark, d)),
    "agreement_histogram": lambda spark, d: agreement_histogram(V.pairs(spark, d)),
    "critic_errors": lambda spark, d: critic_errors(V.pairs(spark, d), V.terms(spark, d)),
    "mqm_scores": lambda spark, d: mqm(V.pairs(spark, d), V.terms(spark, d)),
    "judge_summary": lambda spark, d: judge_summary(V.pairs(spark, d), V.terms(spark, d)),
}

_GRAMS = " union all ".join(
    [f"select conv_id, idx, 'c{n}' as kind, substr(x, i::int, {n}) as gram, h from (select *, unnest(range(1, length(x) - {n - 2})) as i from (select conv_id, idx, replace(x, ' ', '▁') as x, h from side))" for n in range(1, 7)]
    + [f"select conv_id, idx, 'w{n}' as kind, array_to_string(ws[i:i + {n - 1}], chr(9)) as gram, h from (select *, unnest(range(1, len(ws) - {n - 2})) as i from (select conv_id, idx, {T.sql_tokens('x')} as ws, h from side))" for n in (1, 2)]
)
_CHRF = f"""
p as (select * from {V.SQL_PAIRS}), side as (select conv_id, idx, mt as x, 1 as h from p union all select conv_id, idx, src, 0 from p),
cnt as (select conv_id, idx, kind, gram, sum(h) as h, sum(1 - h) as r from ({_GRAMS}) group by all),
m as (select conv_id, idx, kind, sum(h) as h, sum(r) as r, sum(least(h, r)) as m from cnt group by all),
f as (select conv_id, idx, kind, m, case when m > 0 then 2.0 * m::double / (h + r) else 0.0 end as f from m),
g as (select conv_id, idx, sum(f) as s, sum(f) filter (kind like 'c%') as a, count(*) filter (kind like 'c%' and m > 0) as n from f group by 1, 2),
c as (select conv_id, idx, round(case when {T.sql_strip("mt")} = '' or {T.sql_strip("src")} = '' then 0.0 else coalesce(s, 0) / 8 * 100 end, 6) as chrf,
  round(coalesce(case when n > 0 then a / n * 100 end, 0.0), 6) as agreement, {T.sql_strip("mt")} <> '' as second from p left join g using (conv_id, idx))"""
_ERRORS = f"""
  select conv_id, idx, unnest(generate_series(0, len(e) - 1)) as pos, unnest(e) as e from (
    select conv_id, idx, list_filter([
      case when t = '' then 'completeness:critical' end,
      case when t <> '' and {T.sql_count("t", f"[{T.VIETNAMESE}]")}::double / greatest({T.sql_count("t", chr(92) + "p{L}")}, 1) < 0.05 and {T.sql_ratio(T.sql_english("t", 3), T.sql_count("t", T.TOKEN))} > 0.5
        and {T.sql_ratio(T.sql_english("s", 3), T.sql_count("s", T.TOKEN))} > 0.4 and {T.sql_count("s", T.TOKEN)} >= 8 then 'accuracy:critical' end,
      case when t <> '' and length(t)::double / length(s) < 0.3 and length(s) > 50 then 'completeness:major' end,
      case when t <> '' and length(t)::double / length(s) > 3.5 and length(s) > 30 then 'fluency:major' end,
      case when t <> '' and len(list_filter(regexp_extract_all(s, '[0-9]+(?:[.,][0-9]+)*'), lambda n: length(n) > 1 and not list_contains(regexp_extract_all(t, '[0-9]+(?:[.,][0-9]+)*'), n))) > 0 then 'accuracy:minor' end,
      case when t <> '' and astray then 'terminology:minor' end
    ], lambda x: x is not null) as e
    from (select conv_id, idx, {T.sql_strip("src")} as s, {T.sql_strip("mt")} as t,
      exists (select 1 from {V.SQL_TERMS} g where contains(lower(src), g.en) and not contains(lower(mt), lower(g.vi))) as astray from {V.SQL_PAIRS}) where s <> '') where len(e) > 0"""
_MQM = f"""
er as (select conv_id, idx, pos, split_part(e, ':', 1) as category, split_part(e, ':', 2) as severity from ({_ERRORS})),
wt as (select *, case when category in ('fluency', 'terminology') then case severity when 'minor' then 0.1 when 'major' then 1 else 5 end else case severity when 'minor' then 1 when 'major' then 5 else 25 end end as w,
  case severity when 'critical' then 3 when 'major' then 2 else 1 end as rk from er),
gg as (select conv_id, idx, sum(w) as w, count(*) as n, max_by(severity, rk * 100 - pos) as worst from wt group by 1, 2),
mq as (select conv_id, idx, round(greatest(0.0, 100 - coalesce(w, 0))::double, 6) as mqm, coalesce(worst, 'none') as worst, coalesce(n, 0) as n_errors from {V.SQL_PAIRS} left join gg using (conv_id, idx))"""

ORACLE_SQL = {
    "chrf_segments": f"with {_CHRF} select conv_id, idx, chrf, agreement from c",
    "chrf_corpus": f"""with {_CHRF} select conv_id, count(*) as segments, round(avg(chrf), 5) as corpus_chrf,
  case when avg(chrf) >= 70 then 'excellent' when avg(chrf) >= 55 then 'good' when avg(chrf) >= 40 then 'fair' when avg(chrf) >= 25 then 'poor' else 'bad' end as band,
  count(*) filter (chrf < 40) as low_segments from c group by 1""",
    "agreement_histogram": f"""with {_CHRF}, b as (select case when second then agreement else 0.0 end as a, second from c),
k as (select least(9, floor(a / 10))::bigint as bucket, case when not second or a >= 65 then 'consensus' when a >= 40 then 'mild' else 'synthesized' end as v from b)
select bucket, count(v) as n, count(*) filter (v = 'consensus') as consensus, count(*) filter (v = 'mild') as mild, count(*) filter (v = 'synthesized') as synthesized
from (select unnest(range(10))::bigint as bucket) left join k using (bucket) group by 1""",
    "critic_errors": f"select conv_id, idx, pos, split_part(e, ':', 1) as category, split_part(e, ':', 2) as severity from ({_ERRORS})",
    "mqm_scores": f"with {_MQM} select conv_id, idx, mqm, worst, n_errors from mq",
    "judge_summary": f"with {_MQM} select conv_id, count(*) as judged, round_even(avg(mqm), 0)::bigint as avg_score, count(*) filter (mqm < 70) as flagged, sum(n_errors) as n_errors from mq group by 1",
}
