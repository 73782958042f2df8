"""Reports that put several operators together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.operators import glossary, quality, scoring
from vellum.sources import views as V


def worst_segments(rows: DataFrame, terms: DataFrame | None = None, n: int = 20) -> DataFrame:
    """The n pairs with the lowest error-weighted score."""
    return scoring.mqm(rows, terms).orderBy("mqm", "conv_id", "idx").limit(n).select("conv_id", "idx", "mqm", "worst")


def locked_terms(locked: Column) -> Column:
    """Lower case, each once, sorted, without blanks."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(locked, lambda x: F.lower(F.trim(x))), lambda x: x != "")))


def consensus_bands(rows: DataFrame) -> DataFrame:
    """Share of consensus of each conversation in per cent, and its band at 80 and 60."""
    a = scoring.chrf(rows).groupBy("conv_id").agg(F.count("*").alias("n"), F.sum((F.col("agreement") >= 65).cast("int")).alias("consensus"))
    share = F.col("consensus") / F.col("n") * 100
    return a.select("conv_id", "n", F.round(share, 6).alias("share"), F.when(share >= 80, "high").when(share >= 60, "medium").otherwise("low").alias("band"))


def final_status(rows: DataFrame) -> DataFrame:
    """done, or done with warnings where the score is under 70 or a block is untranslated."""
    s = quality.quality_scores(rows)
    return s.select("conv_id", "score", F.when((F.col("score") < 70) | (F.col("untranslated_blocks") > 0), "done_with_warnings").otherwise("done").alias("status"))


def requests(runs: DataFrame) -> DataFrame:
    """Requests of a run: its chunks, its judgements in threes, and two more."""
    return runs.groupBy("pdf").agg(F.count("*").alias("chunks"), F.count("quality").alias("judged")).select("pdf", "chunks", (F.col("chunks") + F.ceil(F.col("judged") / 3) + 2).alias("n_requests"))


def swapped(rows: DataFrame) -> DataFrame:
    """Which chunks of a document go to the second model: those from the middle on."""
    w = Window.partitionBy("conv_id")
    k = F.row_number().over(w.orderBy("idx")) - 1
    return rows.select("conv_id", "idx", k.alias("k"), F.count("*").over(w).alias("n")).select("conv_id", "idx", (F.col("k") >= F.greatest(F.lit(1), F.expr("n div 2"))).alias("second"))


def global_compliance(found: DataFrame) -> DataFrame:
    """All terms together: occurrences, and the share kept, as a ratio of sums."""
    u = glossary.usage(found)
    return u.agg(F.count("*").alias("terms"), F.sum("occurrences").alias("occurrences"), F.round(F.sum(F.col("kept") * F.col("occurrences")) / F.sum("occurrences"), 4).alias("kept"))


def round_robin(log: DataFrame) -> DataFrame:
    """Replay of round robin: the n-th event takes account n modulo the number of users seen by then."""
    first = Window.partitionBy("user_id").orderBy("seq")
    each = log.select("seq", "user_id", (F.row_number().over(first) == 1).cast("int").alias("new"), F.to_date("ts").alias("day"))
    # users by day first, so that the running number is kept over days and not over all events
    day = each.groupBy("day").agg(F.sum("new").alias("new"), F.count("*").alias("n"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    day = day.select("day", F.coalesce(F.sum("new").over(before), F.lit(0)).alias("users"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("events"))
    inside = Window.partitionBy("day").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    r = each.join(day, "day").select("seq", (F.col("users") + F.sum("new").over(inside)).alias("free"), (F.col("events") + F.count("*").over(inside) - 1).alias("k"))
    return r.select("seq", "free", F.pmod("k", "free").alias("place"))


def _log(spark, d) -> DataFrame:
    return V.table(spark, d, "events").select(F.col("event_id").alias("seq"), "user_id", "ts")


def _runs(spark, d) -> DataFrame:
    return V.table(spark, d, "lineitem").select((F.col("l_partkey") % 20).alias("pdf"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("quality"))


QUERIES = {
    "worst_segments": lambda spark, d: worst_segments(V.pairs(spark, d), V.terms(spark, d)),
    "consensus_bands": lambda spark, d: consensus_bands(V.pairs(spark, d)),
    "final_status": lambda spark, d: final_status(V.pairs(spark, d)),
    "run_requests": lambda spark, d: requests(_runs(spark, d)),
    "model_swap": lambda spark, d: swapped(V.pairs(spark, d)),
    "global_compliance": lambda spark, d: global_compliance(glossary.matches(V.pairs(spark, d), V.terms(spark, d))),
    "round_robin": lambda spark, d: round_robin(_log(spark, d)),
    "source_languages": lambda spark, d: V.table(spark, d, "documents").groupBy("source").agg(locked_terms(F.collect_set("lang")).alias("langs"), F.count("*").alias("n")),
}
ORACLE_SQL = {
    "worst_segments": f"select conv_id, idx, mqm, worst from ({scoring.ORACLE_SQL['mqm_scores']}) order by mqm, conv_id, idx limit 20",
    "consensus_bands": f"""with c as ({scoring.ORACLE_SQL['chrf_segments']}), a as (select conv_id, count(*) as n, count(*) filter (agreement >= 65) * 100.0::double / count(*) as share from c group by 1)
select conv_id, n, round(share, 6) as share, case when share >= 80 then 'high' when share >= 60 then 'medium' else 'low' end as band from a""",
    "final_status": f"select conv_id, score, case when score < 70 or untranslated_blocks > 0 then 'done_with_warnings' else 'done' end as status from ({quality.ORACLE_SQL['quality_score']})",
    "run_requests": "select l_partkey % 20 as pdf, count(*) as chunks, (count(*) + ceil(count(*) filter (l_discount > 0) / 3.0) + 2)::bigint as n_requests from lineitem group by 1",
    "model_swap": f"select conv_id, idx, row_number() over (partition by conv_id order by idx) - 1 >= greatest(1, count(*) over (partition by conv_id) // 2) as second from {V.SQL_PAIRS}",
    "global_compliance": f"select count(*) as terms, sum(occurrences) as occurrences, round(sum(kept * occurrences) / sum(occurrences), 4) as kept from ({glossary.ORACLE_SQL['glossary_usage']})",
    "round_robin": """with e as (select event_id as seq, row_number() over (partition by user_id order by event_id) = 1 as new, row_number() over (order by ts::date, event_id) - 1 as k, ts::date as day from events),
f as (select seq, k, sum(new::int) over (order by day, seq rows unbounded preceding) as free from e) select seq, free, k % free as place from f""",
    "source_languages": "select source, list_sort(list(distinct lang)) as langs, count(*) as n from documents group by 1",
}
