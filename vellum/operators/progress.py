"""Progress documents with keys that aren't known beforehand: tables out of them, look-ups by their compound keys, and updates in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.sources import views as V
from vellum.sources.kept import kept

# The maps of chunks in a progress document, and how statuses begin that are under way and that are over.
TOP, INPUT = "translated_chunks", "input_chunks:"
UNDER_WAY = ("starting", "translating", "extracting", "compiling", "resuming")
OVER = ("done", "error", "cancelled", "interrupted", "compile_error")
#: Longest chunk key; a plain number, or ``input:<path>:<number>`` where the path may hold colons.
KEY_LENGTH, PLAIN_KEY, INPUT_KEY = 256, r"^[0-9]+$", r"(?s)^input:(.+):([0-9]+)$"
BUCKETS = 64


def read(progress: DataFrame) -> DataFrame:
    """(job_id, v): progress documents (job_id, json) as variants; what isn't a JSON object is left out."""
    # exploded and not filtered: a filter would go below and parse, and make, each document once more
    parsed = F.filter(F.array(F.try_parse_json("json")), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    return progress.select("job_id", F.explode(parsed).alias("v"))


def _exploded(rows: DataFrame, what: str) -> DataFrame:
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(what).outer()))


def chunk_rows(documents: DataFrame) -> DataFrame:
    """(job_id, chunk_key, mt_latex) of every map of chunks in ``documents`` (job_id, v); a map that is none gives nothing."""
    maps = _exploded(documents, "v").where(((F.col("key") == TOP) | F.col("key").startswith(INPUT)) & (F.expr("schema_of_variant(value)").startswith("OBJECT")))
    maps = maps.select("job_id", F.when(F.col("key") != TOP, F.substring("key", len(INPUT) + 1, 1 << 30)).alias("input"), F.col("value").alias("chunks"))
    each = _exploded(maps, "chunks")
    key = F.when(F.col("input").isNull(), F.col("key")).otherwise(F.concat(F.lit("input:"), "input", F.lit(":"), "key"))
    return each.select("job_id", key.alias("chunk_key"), F.try_variant_get("value", "$", "string").alias("mt_latex"))


def job_rows(documents: DataFrame) -> DataFrame:
    """One row for each of ``documents`` (job_id, v) as the jobs table has it.

    done_chunks counts the keys of all maps of chunks.  total_chunks, num_tabs,
    duration_seconds and agentic are null where the document doesn't say, so that an
    upsert leaves what is stored.
    """
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    maps = F.from_json(F.to_json("v"), "map<string,string>")
    counted = F.map_values(F.map_filter(maps, lambda k, x: (k == TOP) | k.startswith(INPUT)))
    done = F.aggregate(counted, F.lit(0), lambda n, x: n + F.coalesce(F.size(F.json_object_keys(x)), F.lit(0)))
    return documents.select(
        "job_id",
        F.coalesce(get("$.source_type", "string"), F.lit("latex")).alias("source_type"),
        F.coalesce(get("$.arxiv_id", "string"), F.translate("job_id", "_", "/")).alias("arxiv_id"),
        F.coalesce(get("$.status", "string"), F.lit("unknown")).alias("status"),
        done.alias("done_chunks"),
        get("$.quality.score", "double").alias("heuristic_score"),
        get("$.total_chunks", "int").alias("total_chunks"),
        get("$.num_tabs", "int").alias("num_tabs"),
        get("$.duration_seconds", "double").alias("duration_seconds"),
        get("$.agentic", "boolean").alias("agentic"),
    )


# Fixed value: requests that each run makes besides its translations and judgements.
OTHER_REQUESTS = 2


def run_metrics(documents: DataFrame) -> DataFrame:
    """What a benchmark keeps of each of ``documents`` (job_id, v); the numbers of requests and of chunks passed and flagged are null without an evaluation."""
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    loop = get("$.eval_loop", "variant")
    ran = (F.schema_of_variant(loop) != "OBJECT<>") & F.schema_of_variant(loop).startswith("OBJECT")
    length = lambda path: F.coalesce(F.size(F.from_json(F.to_json(get(path, "variant")), "array<string>")), F.lit(0))
    calls = lambda k: get(f"$.eval_loop.{k}", "long")
    requests = F.coalesce(calls("total_translations"), F.lit(0)) + F.coalesce(calls("total_judge_calls"), F.lit(0)) + OTHER_REQUESTS
    return documents.select(
        "job_id", get("$.duration_seconds", "double").alias("duration_seconds"), get("$.total_chunks", "int").alias("total_chunks"), get("$.status").alias("status"),
        calls("total_translations").alias("total_translations"), calls("total_judge_calls").alias("total_judge_calls"), F.when(ran, requests).alias("n_requests"),
        F.when(ran, length("$.eval_loop.passed")).alias("passed"), F.when(ran, length("$.eval_loop.flagged")).alias("flagged"), get("$.quality.score", "double").alias("quality_score"),
    )


def status_rows(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """What a client sees of each of ``asked`` (job_id), out of ``documents`` (job_id, v).

    Without a document the status is unknown and the rest null; without a status it is
    pending.  current_chunk, total_chunks and progress_percent are those of a status
    ``translating i/n``; done is 100.  Titles, phases and the like are null where they are
    empty, counts of glossaries where there is none.
    """
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    text = lambda path: F.nullif(get(path), F.lit(""))
    status = F.coalesce(get("$.status"), F.lit("pending"))
    part = lambda k: F.regexp_extract(status, r"^translating (\d+)/(\d+)", k).try_cast("int")
    percent = F.when(status.isin("done", "done_with_warnings"), 100).when(part(2) > 0, F.bround(part(1) / part(2) * 100).cast("int")).when(part(2) == 0, 0)
    kind = lambda path: F.schema_of_variant(get(path, "variant"))
    keys = lambda path: F.when(kind(path).startswith("OBJECT"), F.size(F.json_object_keys(F.to_json(get(path, "variant"))))).when(kind(path).startswith("ARRAY"), F.size(F.from_json(F.to_json(get(path, "variant")), "array<string>")))
    some = lambda n: F.when(n > 0, n)
    seen = documents.select(
        "job_id", status.alias("status"), F.coalesce(get("$.source_type"), F.lit("pdf_only")).alias("source_type"), F.coalesce(get("$.mode"), F.lit("standard")).alias("mode"),
        F.coalesce(get("$.agentic", "boolean"), F.lit(False)).alias("agentic"), get("$.num_tabs", "int").alias("num_tabs"), get("$.duration_seconds", "double").alias("duration_seconds"),
        text("$.phase").alias("phase"), text("$.title").alias("title"), text("$.base_job_id").alias("base_job_id"), text("$.superseded_by").alias("superseded_by"),
        part(1).alias("current_chunk"), part(2).alias("total_chunks"), percent.alias("progress_percent"), some(keys("$.failed_chunks")).alias("failed_chunks"),
        some(keys("$.glossary.terms")).alias("glossary_count"), keys("$.glossary.seed_terms").alias("glossary_seed_count"), keys("$.glossary.document_terms").alias("glossary_document_count"),
    )
    return asked.select("job_id").join(seen.hint("merge"), "job_id", "left").withColumns({"status": F.coalesce("status", F.lit("unknown")), "source_type": F.coalesce("source_type", F.lit("pdf_only"))})


# ---- look-ups by compound keys ----------------------------------------------------


def key_parts(key: Column) -> Column:
    """(path, idx) of a chunk key, path null for a plain number; null for a key that isn't taken.

    Not taken are keys of over 256 characters, other forms, and paths that begin with a
    slash, hold a backslash or go upwards.
    """
    path, at = F.regexp_extract(key, INPUT_KEY, 1), F.regexp_extract(key, INPUT_KEY, 2)
    upward = F.array_contains(F.split(path, "/"), "..")
    safe = (path != "") & ~path.startswith("/") & ~path.contains("\\") & ~upward
    none = F.lit(None).cast("string")
    parts = F.when(key.rlike(PLAIN_KEY), F.struct(none.alias("path"), key.try_cast("int").alias("idx"))).when(safe, F.struct(path.alias("path"), at.try_cast("int").alias("idx")))
    return F.when(F.length(key).between(1, KEY_LENGTH), parts)


def originals(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """``asked`` (job_id, chunk_key, source_type) with ``text`` and ``problem``.

    ``sources`` has job_id, path, is_main, idx and text: the chunks of every file; of PDF
    jobs those of the file without a path.  A path is looked up as the end of a file's
    path, of several files the least counts.  Problems are bad_key, no_source, no_file
    and out_of_range.  Rows out of variants are taken for far smaller than they are, so
    the joins are merges: a broadcast would hold all chunks in the driver.
    """
    a = asked.withColumn("__key", key_parts(F.col("chunk_key")))
    a = a.withColumn("__key", F.when(~((F.col("source_type") == "pdf_only") & F.col("__key.path").isNotNull()), F.col("__key"))).withColumn("__rel", F.coalesce("__key.path", F.lit("")))
    a, sources = kept(a), kept(sources)  # read three times each
    files = sources.select("job_id", "path", "is_main").distinct()
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    rels = a.select("job_id", "__rel").distinct()  # each path that a job is asked for, "" for the main file
    ends = (F.col("path") == F.col("__rel")) | F.col("path").endswith(F.concat(F.lit("/"), F.col("__rel")))
    named, own = (df.where(F.col(c) != "").withColumn("__base", base(F.col(c))) for df, c in ((rels, "__rel"), (files.select("job_id", "path"), "path")))
    by_path = named.join(own.hint("merge"), ["job_id", "__base"]).where(ends).groupBy("job_id", "__rel").agg(F.min("path").alias("path"))
    jobs = files.groupBy("job_id").agg(F.min(F.when(F.col("is_main"), F.struct("path"))).alias("main"), F.lit(True).alias("__any"))
    placed = rels.join(jobs.hint("merge"), "job_id", "left").join(by_path.hint("merge"), ["job_id", "__rel"], "left")
    of = lambda named, main: F.when(F.col("__rel") != "", named).otherwise(main)
    placed = placed.select("job_id", "__rel", "__any", of(F.col("path").isNotNull(), F.col("main").isNotNull()).alias("__located"), of(F.col("path"), F.col("main.path")).alias("__path"))
    found = a.join(placed.hint("merge"), ["job_id", "__rel"], "left").withColumn("__located", F.col("__key").isNotNull() & F.coalesce("__located", F.lit(False)))
    text = sources.select("job_id", F.coalesce("path", F.lit("")).alias("__p"), F.col("idx").alias("__i"), F.col("text").alias("__text"), F.lit(True).alias("__hit"))
    out = found.withColumns({"__p": F.when(F.col("__located"), F.coalesce("__path", F.lit(""))), "__i": F.col("__key.idx")}).join(text.hint("merge"), ["job_id", "__p", "__i"], "left")
    problem = (
        F.when(F.col("__key").isNull(), "bad_key").when(F.col("__any").isNull(), "no_source").when(~F.col("__located"), "no_file").when(F.col("__hit").isNull(), "out_of_range")
    )
    return out.select(*(f"`{c}`" for c in asked.columns), F.col("__text").alias("text"), problem.alias("problem"))


# ---- in place ---------------------------------------------------------------------


def write(progress: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Progress rows (job_id, status, ...) as a folder of buckets, which ``recover`` rewrites one by one."""
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")
    progress.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def is_interrupted(status: Column) -> Column:
    """Whether a run of that status would be under way."""
    begins = lambda names: F.regexp_like(F.trim(status), F.lit("^(" + "|".join(names) + ")"))
    return F.coalesce(begins(UNDER_WAY) & ~begins(OVER), F.lit(False))


def recover(spark: SparkSession, path: str, active: DataFrame, now: str) -> dict[str, int]:
    """Marks the runs under way that aren't ``active`` (job_id) as interrupted; how many were seen, were active and are marked.

    Only the buckets that hold such a run are written, whole and all at once: files of
    others stay, and doing it again changes nothing.
    """
    rows = spark.read.parquet(path)
    stale = rows.where(is_interrupted(F.col("status"))).join(active.select("job_id").distinct(), "job_id", "left_anti").select("job_id", "bucket")
    stale = kept(stale)
    n = stale.count()
    report = {"scanned": rows.count(), "active": active.select("job_id").distinct().count(), "interrupted": n}
    if not n:
        return report
    touched = rows.join(stale.select("bucket").distinct(), "bucket", "left_semi").join(stale.select("job_id", F.lit(True).alias("__stale")), "job_id", "left")
    at = F.col("interrupted_at") if "interrupted_at" in rows.columns else F.lit(None).cast("string")
    changed = touched.withColumns({"status": F.when(F.col("__stale"), "interrupted").otherwise(F.col("status")), "interrupted_at": F.when(F.col("__stale"), now).otherwise(at)}).drop("__stale")
    changed = kept(changed)  # what is written must not be read from the files that it replaces
    changed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return report


# ---- orders as progress documents -----------------------------------------------------


def _documents(spark, d) -> DataFrame:
    """Line items of an order as its chunks: every third in a map of an input file whose path has a colon, the rest in the main map; other fields by rule."""
    # all that follows is by order, so items are dealt out once
    t = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_orderkey").distinct()
    text = F.concat(F.lit('mt "'), "l_partkey", F.lit('"\n'))
    key = F.concat("l_linenumber", F.lit("-"), "l_partkey", F.lit("-"), "l_suppkey")
    top = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("input_chunks:sec:"), F.col("l_suppkey") % 3, F.lit("/a.tex"))).otherwise(TOP)
    each = t.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.struct(top.alias("top"), key.alias("key"), text.alias("text"))).alias("c"))
    chunks = lambda x: F.map_from_entries(F.transform(F.filter("c", lambda y: y["top"] == x), lambda y: F.struct(y["key"], y["text"])))
    maps = each.select("k", F.transform(F.array_distinct("c.top"), lambda x: F.struct(x.alias("key"), F.to_json(chunks(x)).alias("value"))).alias("maps"))
    k = F.col("k")
    fields = [
        F.when(k % 7 > 0, F.concat(F.lit('"status":"'), F.when(k % 7 == 1, "translating 1/9").otherwise("done"), F.lit('"'))),
        F.when(k % 4 == 0, F.concat(F.lit('"quality":{"score":'), k % 100, F.lit(".5}"))).when(k % 4 == 1, F.lit('"quality":{}')),
        F.when(k % 5 == 0, F.lit('"total_chunks":null')).when(k % 5 == 1, F.concat(F.lit('"total_chunks":'), k % 50)),
        F.when(k % 6 == 0, F.lit('"agentic":true')).when(k % 6 == 1, F.lit('"agentic":false,"source_type":"pdf_only","num_tabs":2')),
        F.array_join(F.transform("maps", lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","),
    ]
    body = F.when(k % 11 > 0, F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))).otherwise("not json")
    return maps.select(F.concat(F.lit("job_"), "k").alias("job_id"), body.alias("json"))


def _evaluated(spark, d) -> DataFrame:
    """Users' events as evaluations: values from 70 pass, those under 30 are flagged; every fourth user has none, every seventh an empty one."""
    e = V.table(spark, d, "events").groupBy(F.col("user_id").alias("u")).agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("value") >= 70, F.col("event_id"))).alias("p"), F.collect_list(F.when(F.col("value") < 30, F.col("event_id"))).alias("f"))
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    loop = F.concat(F.lit('"eval_loop":{"total_translations":'), "n", F.when(F.col("u") % 3 > 0, F.concat(F.lit(',"total_judge_calls":'), F.col("n") * 2)).otherwise(""), F.lit(',"passed":'), listed("p"), F.lit(',"flagged":'), listed("f"), F.lit("}"))
    part = F.when(F.col("u") % 4 == 0, '"status":"done"').when(F.col("u") % 7 == 0, '"eval_loop":{}').otherwise(loop)
    return e.select(F.concat(F.lit("run_"), "u").alias("job_id"), F.concat(F.lit("{"), part, F.lit(',"duration_seconds":1.5}')).alias("json"))


def _asked(spark, d) -> DataFrame:
    t = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    n = F.col("l_partkey") % 4
    path = F.element_at(F.array(*map(F.lit, ("a.tex", "sec:1/a.tex", "../a.tex", "/a.tex", "b\\a.tex", "c.tex", "1/a.tex"))), (F.col("l_suppkey") % 7 + 1).cast("int"))
    key = F.when(F.col("l_linenumber") % 2 == 0, n.cast("string")).when(F.col("l_linenumber") == 5, "x1").otherwise(F.concat(F.lit("input:"), path, F.lit(":"), n))
    return t.select(F.concat(F.lit("job_"), "l_orderkey").alias("job_id"), key.alias("chunk_key"), F.when(F.col("l_orderkey") % 9 == 0, "pdf_only").otherwise("latex").alias("source_type"), "l_linenumber", "l_partkey", "l_suppkey")


def _sources(spark, d) -> DataFrame:
    """The chunks of each job's maps as its files: the main one and one for each input, numbered from 0 in each."""
    rows = chunk_rows(read(_documents(spark, d)))
    path = F.nullif(F.regexp_extract("chunk_key", r"^input:(.+):[^:]+$", 1), F.lit(""))
    order = Window.partitionBy("job_id", "path").orderBy("chunk_key")
    return rows.withColumn("path", path).select("job_id", "path", F.col("path").isNull().alias("is_main"), (F.row_number().over(order) - 1).alias("idx"), F.col("mt_latex").alias("text"))


QUERIES = {
    "progress_jobs": lambda spark, d: job_rows(read(_documents(spark, d))),
    "run_metrics": lambda spark, d: run_metrics(read(_evaluated(spark, d))),
    "progress_chunks": lambda spark, d: chunk_rows(read(_documents(spark, d))),
    "progress_status": lambda spark, d: status_rows(V.table(spark, d, "orders").select(F.concat(F.lit("job_"), "o_orderkey").alias("job_id")), read(_documents(spark, d))).select("job_id", "status", "source_type", "mode", "agentic", "num_tabs", "current_chunk", "total_chunks", "progress_percent"),
    "chunk_originals": lambda spark, d: originals(_asked(spark, d), _sources(spark, d)),
}

_T = "t as (select distinct l_orderkey as k, l_linenumber as i, l_partkey as p, l_suppkey as s from lineitem)"
_CH = f"""{_T}, c as (select 'job_' || k as job_id, case when i % 3 = 0 then 'sec:' || s % 3 || '/a.tex' end as path, i || '-' || p || '-' || s as key, 'mt "' || p || '"' || chr(10) as text from t where k % 11 > 0)"""
ORACLE_SQL = {
    "progress_jobs": f"""with {_T} select 'job_' || k as job_id, case when k % 6 = 1 then 'pdf_only' else 'latex' end as source_type, 'job/' || k as arxiv_id,
  case when k % 7 = 0 then 'unknown' when k % 7 = 1 then 'translating 1/9' else 'done' end as status, count(*)::int as done_chunks, case when k % 4 = 0 then k % 100 + 0.5::double end as heuristic_score,
  case when k % 5 = 1 then k % 50 end::int as total_chunks, case when k % 6 = 1 then 2 end::int as num_tabs, null::double as duration_seconds, case k % 6 when 0 then true when 1 then false end as agentic
from t where k % 11 > 0 group by k""",
    "run_metrics": """with u as (select user_id as u, count(*) as n, count(*) filter (value >= 70) as p, count(*) filter (value < 30) as f, user_id % 4 <> 0 and user_id % 7 <> 0 as ran from events group by 1)
select 'run_' || u as job_id, 1.5::double as duration_seconds, null::int as total_chunks, case when u % 4 = 0 then 'done' end as status, case when ran then n end as total_translations,
  case when ran and u % 3 > 0 then n * 2 end as total_judge_calls, case when ran then n + case when u % 3 > 0 then n * 2 else 0 end + 2 end as n_requests, case when ran then p end::int as passed, case when ran then f end::int as flagged, null::double as quality_score from u""",
    "progress_status": f"""with {_T}, k as (select distinct k from t where k % 11 > 0)
select 'job_' || o_orderkey as job_id, case when k is null then 'unknown' when k % 7 = 0 then 'pending' when k % 7 = 1 then 'translating 1/9' else 'done' end as status,
  case when k % 6 in (0, 2, 3, 4, 5, 1) or k is null then 'pdf_only' end as source_type, case when k is not null then 'standard' end as mode, case when k is not null then k % 6 = 0 end as agentic,
  case when k % 6 = 1 then 2 end::int as num_tabs, case when k % 7 = 1 then 1 end::int as current_chunk, case when k % 7 = 1 then 9 end::int as total_chunks,
  case when k % 7 = 1 then 11 when k % 7 > 1 then 100 end::int as progress_percent from orders left join k on k = o_orderkey""",
    "progress_chunks": f"with {_CH} select job_id, coalesce('input:' || path || ':', '') || key as chunk_key, text as mt_latex from c",
    "chunk_originals": rf"""with {_CH}, src as (select job_id, path, row_number() over (partition by job_id, path order by coalesce('input:' || path || ':', '') || key) - 1 as idx, text from c),
a as (select 'job_' || k as job_id, i, p, s, case when k % 9 = 0 then 'pdf_only' else 'latex' end as source_type,
  case when i % 2 = 0 then (p % 4)::varchar when i = 5 then 'x1' else 'input:' || (['a.tex', 'sec:1/a.tex', '../a.tex', '/a.tex', 'b\a.tex', 'c.tex', '1/a.tex'])[s % 7 + 1] || ':' || p % 4 end as chunk_key,
  case when i % 2 = 1 and i <> 5 then (['a.tex', 'sec:1/a.tex', null, null, null, 'c.tex', '1/a.tex'])[s % 7 + 1] end as rel from t),
b as (select *, i = 5 or (i % 2 = 1 and (rel is null or source_type = 'pdf_only')) as bad, p % 4 as n from a),
f as (select b.*, (select min(src.path) from src where src.job_id = b.job_id and (src.path = b.rel or ends_with(src.path, '/' || b.rel))) as path,
  exists (select 1 from src where src.job_id = b.job_id) as any_src, exists (select 1 from src where src.job_id = b.job_id and src.path is null) as main from b),
z as (select f.*, not bad and any_src and case when rel is not null then path is not null else main end as located from f)
select z.job_id, z.chunk_key, z.source_type, z.i as l_linenumber, z.p as l_partkey, z.s as l_suppkey, src.text,
  case when bad then 'bad_key' when not any_src then 'no_source' when not located then 'no_file' when src.job_id is null then 'out_of_range' end as problem
from z left join src on located and src.job_id = z.job_id and src.path is not distinct from z.path and src.idx = z.n""",
}
