"""Keyed tables: upserts, deletes, look-ups, listings and benchmark aggregates.

Orders serve as jobs, line items as their chunks, customers as users.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import text as T
from vellum.operators import latex, layout
from vellum.sources import views as V


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``new`` laid over it: given columns replace, others stay, unknown ones are dropped, new keys are added."""
    given = [c for c in new.columns if c in table.columns and c not in keys]
    renamed = new.select(*keys, *(F.col(c).alias(f"__{c}") for c in given), F.lit(True).alias("__new"))
    both = table.join(renamed, keys, "full_outer")
    value = lambda c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c)
    return both.select(*[value(c) for c in table.columns])


def delete(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def insert_new(table: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """``new`` rows whose key isn't there yet, each key once, appended."""
    fresh = new.join(table.select(*on), on, "left_anti").dropDuplicates(on)
    return table.unionByName(fresh, allowMissingColumns=True)


def update_where(table: DataFrame, where: Column, **values) -> DataFrame:
    return table.withColumns({c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


STATUS = {"O": "translating 3/10", "F": "done", "P": "error: stopped"}


def jobs(spark, d) -> DataFrame:
    o = V.table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", STATUS["O"]).when(F.col("o_orderstatus") == "F", STATUS["F"]).otherwise(STATUS["P"])
    return o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("owner"), status.alias("status"), F.col("o_totalprice").alias("score"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"), F.col("o_orderpriority").alias("title"))


def chunks(spark, d) -> DataFrame:
    return V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("chunk"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), (F.col("l_returnflag") == "R").cast("int").alias("edited"))


def listing(j: DataFrame, limit: int, offset: int) -> DataFrame:
    return j.orderBy(F.desc_nulls_last("updated_at"), "job_id").offset(offset).limit(limit)


def owned(j: DataFrame, owner: int, with_unowned: bool) -> DataFrame:
    return j.where((F.col("owner") == owner) | (F.lit(with_unowned) & F.col("owner").isNull()))


def ranked(j: DataFrame, n: int) -> DataFrame:
    """Running jobs first, then failed, then done; progress is read from the status."""
    s = F.col("status")
    rank = F.when(s.rlike("^(starting|translating|judging)"), 0).when(s.startswith("error"), 1).otherwise(2)
    i, of = F.regexp_extract(s, r"translating (\d+)/(\d+)", 1).try_cast("double"), F.regexp_extract(s, r"translating (\d+)/(\d+)", 2).try_cast("double")
    progress = F.when(s == "done", 100.0).otherwise(F.coalesce(F.round(i / of * 100, 3), F.lit(0.0)))
    return j.withColumns({"rank": rank, "progress": progress}).orderBy("rank", F.desc("updated_at"), "job_id").limit(n).select("job_id", "status", "rank", "progress")


def synced(j: DataFrame, c: DataFrame) -> DataFrame:
    """Jobs with their numbers of chunks and of edited ones."""
    g = c.groupBy("job_id").agg(F.count("*").alias("total_chunks"), F.sum("edited").alias("done_chunks"))
    return j.join(g, "job_id", "left").select("job_id", "owner", F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"), F.coalesce("done_chunks", F.lit(0)).alias("done_chunks"))


def recovered(j: DataFrame, active: DataFrame) -> DataFrame:
    """Jobs that were running and aren't active, marked as interrupted."""
    return j.where(F.col("status").rlike("^(starting|translating|judging)")).join(active, "job_id", "left_anti").select("job_id", F.lit("interrupted").alias("status"))


def same_document(j: DataFrame) -> DataFrame:
    """Earlier runs of the same document: title and owner, the first run of each and how many followed."""
    return j.groupBy(F.lower(F.trim("title")).alias("title"), "owner").agg(F.min("job_id").alias("first_job"), F.count("*").alias("runs")).where("runs > 1")


def stats_by_field(j: DataFrame) -> DataFrame:
    field = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("uncategorized"))
    return j.groupBy(field.alias("field")).agg(F.count("*").alias("n"), F.sum((F.col("score") >= 100_000).cast("int")).alias("high"), F.round(F.avg("score"), 4).alias("avg_score"))


# ---- benchmark runs ---------------------------------------------------------------


def runs(spark, d) -> DataFrame:
    """Line items as benchmark runs: pdf, number of tabs, seconds (0 counts as missing)."""
    return V.table(spark, d, "lineitem").select((F.col("l_partkey") % 20).alias("pdf"), (F.col("l_suppkey") % 6 + 1).alias("num_tabs"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).otherwise(0.0).alias("wall"), F.col("l_extendedprice").alias("duration"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("quality"))


def aggregated(r: DataFrame) -> DataFrame:
    seconds = F.when(F.col("wall") != 0, F.col("wall")).otherwise(F.when(F.col("duration") != 0, F.col("duration") / 1000))
    return r.withColumn("s", seconds).groupBy("pdf", "num_tabs").agg(F.count("*").alias("n"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.avg("quality").alias("quality"))


def derived(a: DataFrame) -> DataFrame:
    """Speed-up against one tab, efficiency and throughput."""
    one = a.where("num_tabs = 1").select("pdf", F.col("mean").alias("base"))
    j = a.join(one, "pdf", "left")
    r = lambda c: F.round(c, 6)
    return j.select("pdf", "num_tabs", "n", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"), r(F.col("quality")).alias("quality"), r(F.col("base") / F.col("mean")).alias("speedup"), r(F.col("base") / F.col("mean") / F.col("num_tabs")).alias("efficiency"), r(F.col("n") / F.col("mean")).alias("throughput"))


def latencies(r: DataFrame, width: float = 64.0) -> DataFrame:
    """Median and nearest-rank 95th percentile, the value at place int(n * 0.95) of the sorted ones; missing durations don't count.

    Counts by stretches of ``width`` say in which stretch a rank lies; only the values of
    those stretches are put in order, so no task sorts a whole group.
    """
    stretch = F.floor(F.col("duration") / width)
    rows = r.where("duration is not null").select("num_tabs", "duration", stretch.alias("b"))
    counts = rows.groupBy("num_tabs", "b").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("num_tabs").orderBy("b"))
    placed = counts.select("num_tabs", "b", (upto - F.col("m")).alias("before"), upto.alias("upto"), F.sum("m").over(Window.partitionBy("num_tabs")).alias("n"))
    ranks = F.array(*(F.struct(F.lit(name).alias("name"), k.cast("long").alias("k")) for name, k in (("low", F.floor((F.col("n") + 1) / 2)), ("high", F.ceil((F.col("n") + 1) / 2)), ("p95", F.greatest(F.floor(F.col("n") * 0.95), F.lit(1))))))
    asked = placed.select("num_tabs", "b", "n", "before", "upto", F.inline(ranks)).where("k > before and k <= upto")
    wanted = asked.select("num_tabs", "b").distinct()
    inside = F.row_number().over(Window.partitionBy("num_tabs", "b").orderBy("duration"))
    near = rows.join(wanted, ["num_tabs", "b"], "left_semi").withColumn("i", inside)
    found = asked.join(near, ["num_tabs", "b"]).where("i = k - before")
    value = lambda name: F.max(F.when(F.col("name") == name, F.col("duration")))
    return found.groupBy("num_tabs", "n").agg(F.round((value("low") + value("high")) / 2, 6).alias("p50"), value("p95").alias("p95"))


def told_blocks(spark, d) -> DataFrame:
    """Pairs as translated blocks with budgets: every fifth a table cell, every seventh a caption, boxes by rule of their place."""
    kind = F.when(F.col("idx") % 5 == 0, "table").when(F.col("idx") % 7 == 0, "caption").otherwise("plain")
    width, height, size = (F.col("idx") % 4) * 90.0, (F.col("conv_id") % 6) * 14.0, 8.0 + F.col("conv_id") % 3
    zero = F.lit(0.0)
    p = V.pairs(spark, d).select("conv_id", "idx", "src", "mt", kind.alias("kind"), layout.capacity(zero, zero, width, height, size).alias("fits"))
    return p.select("conv_id", "idx", "src", "kind", "fits", layout.block_budget(F.col("fits"), F.length("src"), F.col("kind")).alias("budget"), F.length(T.strip(F.col("mt"))).alias("n_vi"))


def names(spark, d) -> DataFrame:
    """Normal forms of names: slug, user name, cleaned field."""
    c = V.table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return c.select("p_partkey", T.slug(F.col("p_name")).alias("slug"), T.safe_username(F.concat(F.lit("._"), F.col("p_name"), F.lit(" x."))).alias("user"), T.clean_field(F.col("p_type")).alias("field"), F.sha2("p_name", 256).alias("digest"))


def _j(f):
    return lambda spark, d: f(jobs(spark, d))


_NEW = lambda j: j.where("job_id % 10 = 0").select((F.col("job_id") + F.when(F.col("job_id") % 20 == 0, 10_000_000).otherwise(0)).alias("job_id"), F.lit("done").alias("status"), F.lit(1).alias("unknown"))
QUERIES = {
    "job_upsert": _j(lambda j: upsert(j, _NEW(j), ["job_id"])),
    "job_delete": _j(lambda j: delete(j, j.where("score < 50000"), ["job_id"])),
    "job_insert_new": _j(lambda j: insert_new(j, _NEW(j).drop("unknown"), ["job_id"])),
    "job_update": _j(lambda j: update_where(j, F.col("owner").isNull(), status="unowned", score=0.0)),
    "job_listing": _j(lambda j: listing(j, 50, 20)),
    "job_ranked": _j(lambda j: ranked(j, 100)),
    "job_owned": _j(lambda j: owned(j, 10, True)),
    "job_recovery": lambda spark, d: recovered(jobs(spark, d), chunks(spark, d).where("quantity >= 49").select("job_id").distinct()),
    "job_synced": lambda spark, d: synced(jobs(spark, d), chunks(spark, d)),
    "job_same_document": _j(same_document),
    "job_field_stats": _j(stats_by_field),
    "bench_aggregate": lambda spark, d: derived(aggregated(runs(spark, d))),
    "bench_latency": lambda spark, d: latencies(runs(spark, d)),
    "block_budgets": lambda spark, d: told_blocks(spark, d).select("conv_id", "idx", "kind", "fits", "budget"),
    "budget_prompts": lambda spark, d: layout.budgeted_text(told_blocks(spark, d).select(F.col("conv_id").alias("chunk"), F.col("idx").alias("block_idx"), F.col("src").alias("text"), "kind", "budget")),
    "budget_compliance": lambda spark, d: latex.budget_use(told_blocks(spark, d)),
    "budget_worst": lambda spark, d: latex.worst_excess(told_blocks(spark, d), ["conv_id", "idx"]),
    "name_forms": names,
}

_J = "j as (select o_orderkey as job_id, case when o_custkey % 7 <> 0 then o_custkey end as owner, case o_orderstatus when 'O' then 'translating 3/10' when 'F' then 'done' else 'error: stopped' end as status, o_totalprice as score, strftime(o_orderdate, '%Y-%m-%d') as updated_at, o_orderpriority as title from orders)"
_N = "n as (select job_id + case when job_id % 20 = 0 then 10000000 else 0 end as job_id, 'done' as status from j where job_id % 10 = 0)"
_R = "r as (select l_partkey % 20 as pdf, l_suppkey % 6 + 1 as num_tabs, case when l_linenumber > 1 then l_quantity else 0.0 end as wall, l_extendedprice as duration, case when l_discount > 0 then l_discount end as quality from lineitem)"
_TIER = lambda name: "case when fits = 0 then case when trunc(length(src) * {2}) = 0 then 100 else trunc(length(src) * {2})::int end else greatest(trunc(fits * {0}), trunc(length(src) * {1}))::int end".format(*(f"{x}::double" for x in layout.BUDGETS[name]))
_B = f"""bx as (select conv_id, idx, src, mt, case when idx % 5 = 0 then 'table' when idx % 7 = 0 then 'caption' else 'plain' end as kind, (idx % 4) * 90.0::double as w, (conv_id % 6) * 14.0::double as h, 8.0::double + conv_id % 3 as fs from {V.SQL_PAIRS}),
bf as (select *, trunc(w / (fs * 0.5::double) * (h / (fs * 1.35::double)))::int as fits from bx),
bl as (select conv_id, idx, src, kind, fits, case kind when 'table' then {_TIER("table")} when 'caption' then {_TIER("caption")} else {_TIER("plain")} end as budget, length({T.sql_strip("mt")}) as n_vi from bf)"""
ORACLE_SQL = {
    "job_upsert": f"with {_J}, {_N} select coalesce(j.job_id, n.job_id) as job_id, owner, coalesce(n.status, j.status) as status, score, updated_at, title from j full join n on j.job_id = n.job_id",
    "job_delete": f"with {_J} select * from j where not score < 50000",
    "job_insert_new": f"with {_J}, {_N} select * from j union all select job_id, null, status, null, null, null from n where job_id not in (select job_id from j)",
    "job_update": f"with {_J} select job_id, owner, case when owner is null then 'unowned' else status end as status, case when owner is null then 0.0 else score end as score, updated_at, title from j",
    "job_listing": f"with {_J} select * from j order by updated_at desc, job_id limit 50 offset 20",
    "job_ranked": f"with {_J} select job_id, status, rank, progress from (select *, case when status like 'translating%' then 0 when status like 'error%' then 1 else 2 end as rank, case when status = 'done' then 100.0 when status like 'translating%' then 30.0 else 0.0 end as progress from j) order by rank, updated_at desc, job_id limit 100",
    "job_owned": f"with {_J} select * from j where owner = 10 or owner is null",
    "job_recovery": f"with {_J} select job_id, 'interrupted' as status from j where status like 'translating%' and job_id not in (select l_orderkey from lineitem where l_quantity >= 49)",
    "job_synced": f"with {_J} select job_id, owner, coalesce(n, 0) as total_chunks, coalesce(e, 0) as done_chunks from j left join (select l_orderkey as job_id, count(*) as n, count(*) filter (l_returnflag = 'R') as e from lineitem group by 1) using (job_id)",
    "job_same_document": f"with {_J} select lower(trim(title)) as title, owner, min(job_id) as first_job, count(*) as runs from j group by 1, 2 having count(*) > 1",
    "job_field_stats": f"with {_J} select coalesce(nullif(trim(title), ''), 'uncategorized') as field, count(*) as n, count(*) filter (score >= 100000) as high, round(avg(score), 4) as avg_score from j group by 1",
    "bench_aggregate": f"""with {_R}, a as (select pdf, num_tabs, count(*) as n, avg(s) as mean, stddev_pop(s) as std, avg(quality) as quality from (select *, case when wall <> 0 then wall when duration <> 0 then duration / 1000 end as s from r) group by 1, 2)
select a.pdf, a.num_tabs, a.n, round(a.mean, 6) as mean, round(a.std, 6) as std, round(a.quality, 6) as quality, round(b.mean / a.mean, 6) as speedup, round(b.mean / a.mean / a.num_tabs, 6) as efficiency, round(a.n / a.mean, 6) as throughput
from a left join a b on b.pdf = a.pdf and b.num_tabs = 1""",
    "bench_latency": f"""with {_R}, k as (select num_tabs, duration, row_number() over (partition by num_tabs order by duration, pdf) as k, count(*) over (partition by num_tabs) as n from r)
select num_tabs, count(*) as n, round(median(duration), 6) as p50, max(duration) filter (k = greatest(floor(n * 0.95), 1)) as p95 from k group by 1""",
    "block_budgets": f"with {_B} select conv_id, idx, kind, fits, budget from bl",
    "budget_prompts": f"""with {_B}, n as (select *, row_number() over (partition by conv_id order by idx) as k from bl)
select conv_id as chunk, string_agg('[' || k || '] (' || case kind when 'table' then 'table cell, ' when 'caption' then 'caption, ' else '' end || 'max ~' || budget || ' chars) ' || src, chr(10) || chr(10) order by idx) as text, count(*) as n_blocks from n group by 1""",
    "budget_compliance": f"""with {_B}, o as (select *, n_vi > budget as o, (n_vi - budget)::double / budget as ex from bl where n_vi > 0),
s as (select 'kind' as dimension, kind as value, o, n_vi, budget from o
  union all select 'budget', case when budget <= 20 then '1-20' when budget <= 50 then '21-50' when budget <= 150 then '51-150' when budget <= 400 then '151-400' else '>400' end, o, n_vi, budget from o
  union all select 'excess', case when ex < 0.25 then '0-25%' when ex < 0.5 then '25-50%' when ex < 1 then '50-100%' else '>100%' end, o, n_vi, budget from o where o)
select dimension, value, count(*) filter (not o) as under, count(*) filter (o) as over, sum(n_vi)::bigint as chars, sum(budget)::bigint as budget from s group by 1, 2""",
    "budget_worst": f"with {_B} select conv_id, idx, budget, n_vi, round((n_vi - budget)::double / budget, 6) as excess from bl where n_vi > budget order by excess desc, conv_id, idx limit 10",
    "name_forms": r"""select p_partkey, left(regexp_replace(regexp_replace(p_name, '\.[^.]*$', ''), '[^\w-]+', '_', 'g'), 50) as slug,
  left(regexp_replace(regexp_replace('._' || p_name || ' x.', '[^\w.-]', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 64) as "user", nullif(left(trim(p_type), 64), '') as field, sha256(p_name) as digest from part""",
}
