"""Likely causes of low quality, found over the ordered chunks of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import text as T
from vellum.sources import views as V

# Fixed value: what counts as mathematics inside running text.
MATH = (
    r"(?i)(\$[^$]{3,}\$|\\(?:frac|sum|int|alpha|beta|theta|gamma|delta|sigma|lambda|omega|pi|mu|nu|xi|zeta|eta)\b"
    r"|[∀∃∈∉⊆⊇∪∩∧∨¬→↔≤≥≠≈∞√∂∇∑∏∫±×÷]|[Α-ω]{2,})"
)
# Of each cause the most confidence, its base and step by chunk, its severity, the chunks from which it is critical, and the least chunks.
NEVER = 2**31 - 1
RULES = {
    "TRUNCATED_RESPONSE": (0.95, 0.55, 0.08, "warning", 3, 1),
    "EMPTY_TRANSLATION": (0.98, 0.60, 0.06, "warning", 2, 1),
    "MATH_CONTAMINATION": (0.90, 0.50, 0.07, "warning", NEVER, 1),
    "HALLUCINATION": (0.85, 0.50, 0.08, "warning", NEVER, 1),
    "CHUNK_BOUNDARY_SPLIT": (0.75, 0.40, 0.05, "info", NEVER, 2),
}
SEVERITY = {"critical": 3, "warning": 2, "info": 1}


def _stripped(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "idx", "src", "mt", T.strip(F.col("src")).alias("s"), T.strip(F.col("mt")).alias("t"))


def findings(rows: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(conv_id, cause, severity, confidence, affected) of every detector that fires.

    ``failed`` (conv_id, idx) are chunks that a run has marked as failed; they count as
    empty translations, whether or not their text is known.
    """
    r, s, t = _stripped(rows), F.col("s"), F.col("t")
    ratio = F.length(t) / F.length(s)
    maths = T.found(F.col("src"), MATH)
    starts, ends = F.left(s, F.lit(80)).rlike(r"^[a-z,;:\-–—(]"), s.rlike(r"[,;:\-–—a-z(]$")
    fires = {
        "TRUNCATED_RESPONSE": (F.length(s) >= 50) & (t != "") & ((ratio < 0.25) | ((ratio < 0.40) & ~t.rlike(T.SENTENCE_END))),
        "EMPTY_TRANSLATION": (F.length(s) >= 30) & ((F.length(t) < 10) | (T.english_heavy(t) & ~T.english_heavy(F.left(s, F.lit(200))))),
        "MATH_CONTAMINATION": (F.size(maths) >= 3) & (F.aggregate(maths, F.lit(0), lambda a, x: a + F.length(x)) / F.length("src") > 0.12),
        "HALLUCINATION": (F.length(s) >= 50) & (t != "") & (ratio > 3.0),
        "CHUNK_BOUNDARY_SPLIT": (F.length(s) >= 50) & (starts | ends),
    }
    # all detectors look at a chunk in one pass; a chunk counts once for each cause
    found = r.select("conv_id", "idx", F.explode(F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in fires.items())), lambda x: x.isNotNull())).alias("cause"))
    if failed is not None:
        found = found.unionByName(failed.select("conv_id", "idx", F.lit("EMPTY_TRANSLATION").alias("cause")))
    g = found.groupBy("conv_id", "cause").agg(F.array_sort(F.collect_set("idx")).alias("affected")).withColumn("n", F.size("affected"))
    by_cause = lambda place: F.coalesce(*(F.when(F.col("cause") == k, F.lit(v[place])) for k, v in RULES.items()))
    severity = F.when(F.col("n") >= by_cause(4), "critical").otherwise(by_cause(3))
    confidence = F.round(F.least(by_cause(0), by_cause(1) + F.col("n") * by_cause(2)), 6)
    told = g.where(F.col("n") >= by_cause(5)).select("conv_id", "cause", severity.alias("severity"), confidence.alias("confidence"), "affected")
    return told.unionByName(session_limit(rows))


def session_limit(rows: DataFrame) -> DataFrame:
    """Quality that falls from the first third of the chunks to the last, by the length-ratio proxy."""
    r = _stripped(rows).where("t <> '' and length(s) > 30")
    y = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(F.length("t") / F.length("s") - 1) * 0.5))
    order = Window.partitionBy("conv_id").orderBy("idx")
    r = r.select("conv_id", "idx", y.alias("y"), (F.row_number().over(order) - 1).alias("k"), F.count("*").over(Window.partitionBy("conv_id")).alias("n")).where("n >= 6")
    third = F.when(F.col("k") < F.expr("n div 3"), 1).when(F.col("k") < F.expr("2 * n div 3"), 2).otherwise(3)
    q = lambda i: F.avg(F.when(third == i, F.col("y"))).alias(f"q{i}")
    bad = F.array_sort(F.collect_list(F.when(F.col("y") < 0.65, F.col("idx"))))
    g = r.groupBy("conv_id").agg(q(1), q(2), q(3), F.first("n").alias("n"), bad.alias("affected")).where("q1 > q2 and q2 > q3 and q1 - q3 > 0.12 and q3 < 0.72")
    confidence = 0.55 + F.when(F.expr("q2 - q3 > q1 - q2"), 0.15).otherwise(0.0) + F.least(F.lit(0.15), (F.expr("q1 - q3") - 0.12) * 1.5) + F.least(F.lit(0.10), (F.col("n") - 6) * 0.01)
    return g.select("conv_id", F.lit("SESSION_LIMIT").alias("cause"), F.lit("warning").alias("severity"), F.round(F.least(F.lit(0.90), confidence), 6).alias("confidence"), "affected")


def overall(found: DataFrame) -> DataFrame:
    """Primary cause and severity of each document; critical only with a confidence over 0.7."""
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "warning", 2).otherwise(1)
    sure = (F.col("severity") == "critical") & (F.col("confidence") > 0.7)
    sev = F.when(F.bool_or(sure), "critical").when(F.bool_or(F.col("severity").isin("critical", "warning")), "warning").otherwise("info")
    return found.groupBy("conv_id").agg(F.count("*").alias("n_findings"), F.max_by("cause", F.struct(rank * F.col("confidence"), "cause")).alias("primary_cause"), sev.alias("severity"))


def _failed(spark, d) -> DataFrame:
    """Every fiftieth pair, and a chunk without text in every seventieth conversation, marked as failed."""
    p = V.pairs(spark, d)
    return p.where("(conv_id + idx) % 50 = 0").select("conv_id", "idx").unionByName(p.where("conv_id % 70 = 0").select("conv_id", F.lit(-1).cast(p.schema["idx"].dataType).alias("idx")))


QUERIES = {
    "diagnostic_findings": lambda spark, d: findings(V.pairs(spark, d), _failed(spark, d)),
    "diagnostic_report": lambda spark, d: overall(findings(V.pairs(spark, d), _failed(spark, d))),
}

_HEAVY = lambda x: f"(length({T.sql_strip(x)}) >= 20 and {T.sql_english(x)} >= 5 and {T.sql_count(f'lower({x})', f'[{T.VIETNAMESE}]')} < {T.sql_english(x)} * 0.5)"
_ONE = lambda cause, where, most, base, step, sev, least=1: f"select conv_id, '{cause}' as cause, {sev} as severity, round(least({most}, {base} + count(*) * {step})::double, 6) as confidence, list(idx order by idx) as affected from r where {where} group by 1 having count(*) >= {least}"
_MATHS = f"regexp_extract_all(src, '{MATH}')"
_FINDINGS = f"""
r as (select conv_id, idx, src, {T.sql_strip("src")} as s, {T.sql_strip("mt")} as t from {V.SQL_PAIRS}),
y as (select conv_id, idx, greatest(0.0, least(1.0, 1 - abs(length(t)::double / length(s) - 1) * 0.5)) as y, row_number() over (partition by conv_id order by idx) - 1 as k, count(*) over (partition by conv_id) as n from r where t <> '' and length(s) > 30),
q as (select conv_id, avg(y) filter (k < n // 3) as q1, avg(y) filter (k >= n // 3 and k < 2 * n // 3) as q2, avg(y) filter (k >= 2 * n // 3) as q3, any_value(n) as n, coalesce(list(idx order by idx) filter (y < 0.65), []) as affected from y where n >= 6 group by 1),
fi as (
{_ONE("TRUNCATED_RESPONSE", f"length(s) >= 50 and t <> '' and (length(t)::double / length(s) < 0.25 or (length(t)::double / length(s) < 0.40 and not regexp_matches(t, '{T.SENTENCE_END}')))", 0.95, 0.55, 0.08, "case when count(*) >= 3 then 'critical' else 'warning' end")}
union all {_ONE("EMPTY_TRANSLATION", "true", 0.98, 0.60, 0.06, "case when count(*) >= 2 then 'critical' else 'warning' end").replace(" from r ", f" from (select conv_id, idx from r where length(s) >= 30 and (length(t) < 10 or ({_HEAVY('t')} and not {_HEAVY('left(s, 200)')})) union select conv_id, idx from r where (conv_id + idx) % 50 = 0 union select conv_id, -1 from r where conv_id % 70 = 0) ")}
union all {_ONE("MATH_CONTAMINATION", f"len({_MATHS}) >= 3 and list_sum(list_transform({_MATHS}, lambda m: length(m)))::double / length(src) > 0.12", 0.90, 0.50, 0.07, "'warning'")}
union all {_ONE("HALLUCINATION", "length(s) >= 50 and t <> '' and length(t)::double / length(s) > 3.0", 0.85, 0.50, 0.08, "'warning'")}
union all {_ONE("CHUNK_BOUNDARY_SPLIT", "length(s) >= 50 and (regexp_matches(left(s, 80), '^[a-z,;:" + chr(92) + "-–—(]') or regexp_matches(s, '[,;:" + chr(92) + "-–—a-z(]$'))", 0.75, 0.40, 0.05, "'info'", 2)}
union all select conv_id, 'SESSION_LIMIT', 'warning', round(least(0.90, 0.55 + case when q2 - q3 > q1 - q2 then 0.15 else 0.0 end + least(0.15, (q1 - q3 - 0.12) * 1.5) + least(0.10, (n - 6) * 0.01)), 6), affected
  from q where q1 > q2 and q2 > q3 and q1 - q3 > 0.12 and q3 < 0.72)"""
ORACLE_SQL = {
    "diagnostic_findings": f"with {_FINDINGS} select conv_id, cause, severity, confidence, affected from fi",
    "diagnostic_report": f"""with {_FINDINGS} select conv_id, count(*) as n_findings,
  arg_max(cause, {{'s': case severity when 'critical' then 3 when 'warning' then 2 else 1 end * confidence, 'c': cause}}) as primary_cause,
  case when bool_or(severity = 'critical' and confidence > 0.7) then 'critical' when bool_or(severity in ('critical', 'warning')) then 'warning' else 'info' end as severity from fi group by 1""",
}
