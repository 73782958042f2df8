"""Advice on a choice of models, out of what the latest runs say of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.progress import read
from vellum.plans.responses import KNOWN_MODELS, execution_order, model_preference
from vellum.sources import views as V
from vellum.sources.kept import kept

# Runs that are looked at, and the share of tries under which the first choice is said to be little used.
RECENT, LITTLE = 8, 0.5


def _exploded(rows: DataFrame, what: str) -> DataFrame:
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(what).outer()))


def preference_advice(documents: DataFrame, chosen: str, limit: int = RECENT) -> DataFrame:
    """One row of what the ``limit`` latest of ``documents`` (job_id, changed, v) say of a choice of models.

    (models, execution_order, fallback_models, primary, recent_jobs, selected_jobs, usage,
    failures, primary_usage_share, warnings).  A try counts for the model that was taken,
    else asked; failures are tries without success, chunks listed as failed, and runs whose
    status or error names the model.  Of equal times the lesser job_id is the later.
    """
    known = F.array(*map(F.lit, KNOWN_MODELS))
    recent = kept(documents.orderBy(F.desc("changed"), "job_id").limit(limit))
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    choice = recent.sparkSession.range(1).select(model_preference(F.lit(chosen)).alias("models"))
    choice = choice.withColumns({"execution_order": execution_order(F.col("models")), "primary": F.get("models", F.lit(0))})

    tries = recent.select("job_id", get("$.translation_attempts", "variant").alias("a")).where("a is not null")
    lists = _exploded(tries, "a").where("schema_of_variant(value) like 'ARRAY%'").select(F.col("value").alias("records"))
    each = _exploded(lists, "records").where("schema_of_variant(value) like 'OBJECT%'")
    of = lambda k: F.nullif(F.try_variant_get("value", f"$.{k}", "string"), F.lit(""))
    each = each.select(F.lower(F.coalesce(of("selected_model"), of("model"))).alias("model"), F.try_variant_get("value", "$.ok", "boolean").alias("ok")).where(F.array_contains(known, F.col("model")))
    used = each.groupBy("model").agg(F.count("*").alias("usage"), F.sum((F.coalesce("ok", F.lit(True)) == F.lit(False)).cast("long")).alias("failures"))

    names = lambda m: F.lower(F.coalesce(get("$.status"), F.lit(""))).contains(m) | F.lower(F.coalesce(get("$.error_detail.message"), F.lit(""))).contains(m)
    listed = lambda m: F.coalesce(F.size(F.from_json(F.to_json(get(f"$.failed_chunks_{m}", "variant")), "array<string>")), F.lit(0))
    told = F.array(*(F.struct(F.lit(m).alias("model"), (listed(m) + names(m).cast("int")).cast("long").alias("n")) for m in KNOWN_MODELS))
    other = recent.select(F.inline(told)).groupBy("model").agg(F.sum("n").alias("n"))
    counts = other.join(used, "model", "full_outer").select("model", F.coalesce("usage", F.lit(0)).cast("long").alias("usage"), (F.coalesce("failures", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("failures"))
    maps = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c) > 0, F.struct("model", c))))).alias(c)
    sums = counts.agg(maps("usage"), maps("failures"), F.coalesce(F.sum("usage"), F.lit(0)).alias("total"))

    own = model_preference(F.to_json(get("$.models", "variant")))
    jobs = recent.crossJoin(F.broadcast(choice.select("primary"))).agg(F.count("*").alias("recent_jobs"), F.coalesce(F.sum(F.array_contains(own, F.col("primary")).cast("long")), F.lit(0)).alias("selected_jobs"))
    row = choice.crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(jobs))  # three tables of one row
    of_primary = lambda c: F.coalesce(F.try_element_at(c, "primary"), F.lit(0))
    share = F.when(F.col("total") > 0, F.bround(of_primary("usage") / F.col("total"), 3))
    fallback = F.array_except("execution_order", "models")
    warnings = F.array_compact(F.array(F.when(F.size(fallback) > 0, "emergency_fallback_enabled"), F.when(of_primary("failures") > 0, "primary_recent_failures"), F.when(share < LITTLE, "primary_low_usage")))
    return row.select("models", "execution_order", fallback.alias("fallback_models"), "primary", "recent_jobs", "selected_jobs", "usage", "failures", share.alias("primary_usage_share"), warnings.alias("warnings"))


def _documents(spark, d) -> DataFrame:
    """Users as runs, changed by their latest event; events are tries of the models in turn, by hour."""
    e = V.table(spark, d, "events").where("user_id is not null")
    model = F.element_at(F.array(*map(F.lit, KNOWN_MODELS)), (F.col("event_id") % 6 + 1).cast("int"))
    record = F.struct(F.when(F.col("event_id") % 5 > 0, model).alias("selected_model"), F.lit("grok").alias("model"), (F.col("value") >= 30).alias("ok"))
    hours = e.groupBy("user_id", F.date_format("ts", "dd-HH").alias("h")).agg(F.collect_list(record).alias("r"), F.max("ts").alias("ts"))
    runs = hours.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("h", "r")))).alias("tries"), F.max("ts").alias("changed"))
    u = F.col("user_id")
    models = F.when(u % 2 == 0, '["gemini","grok"]').otherwise('["GROK"]')
    body = F.concat(F.lit('{"models":'), models, F.lit(',"status":"'), F.when(u % 3 == 0, "error in Gemini").otherwise("done"), F.lit('","failed_chunks_gemini":['), F.when(u % 4 == 0, "1,2").otherwise(""), F.lit('],"translation_attempts":'), "tries", F.lit("}"))
    return runs.select(F.format_string("%05d", u).alias("job_id"), "changed", body.alias("json"))


def _advice(spark, d) -> DataFrame:
    docs = _documents(spark, d)
    v = read(docs).join(docs.select("job_id", "changed"), "job_id")
    a = preference_advice(v, "gemini")
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return a.select("primary", F.array_join("execution_order", ",").alias("execution_order"), "recent_jobs", "selected_jobs", flat("usage").alias("usage"), flat("failures").alias("failures"), "primary_usage_share", F.array_join("warnings", ",").alias("warnings"))


QUERIES = {"model_preference_advice": _advice}
_MODELS = list(KNOWN_MODELS)
ORACLE_SQL = {
    "model_preference_advice": f"""with r as (select user_id from events group by 1 order by max(ts) desc, printf('%05d', user_id) limit {RECENT}),
t as (select case when event_id % 5 > 0 then ({_MODELS})[event_id % 6 + 1] else 'grok' end as model, value >= 30 as ok from events where user_id in (select user_id from r)),
u as (select model, count(*) as n, count(*) filter (not ok) as f from t group by 1),
x as (select 'gemini' as model, sum(case when user_id % 4 = 0 then 2 else 0 end + (user_id % 3 = 0)::int) as n from r),
f as (select model, sum(n) as n from (select model, f as n from u union all select model, n from x) group by 1),
s as (select round((select n from u where model = 'gemini') / (select sum(n) from u), 3) as share)
select 'gemini' as primary, '{",".join(_MODELS)}' as execution_order, (select count(*) from r) as recent_jobs, (select count(*) from r where user_id % 2 = 0) as selected_jobs,
  (select string_agg(model || '=' || n, ',' order by model) from u) as usage, (select string_agg(model || '=' || n::bigint, ',' order by model) from f where n > 0) as failures, share as primary_usage_share,
  'emergency_fallback_enabled' || case when (select n from f where model = 'gemini') > 0 then ',primary_recent_failures' else '' end || case when share < {LITTLE} then ',primary_low_usage' else '' end as warnings from s""",
}
