"""Views of runs and their progress: status, look-ups, recovery, memory and handing over.

A progress row has job_id, status, failed_chunks (array), retry_count, title,
page_count, base_job_id; orders and their line items serve as such in the queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType
from pyspark.sql.window import Window

from vellum.functions import text as T
from vellum.operators import geometry, relational
from vellum.sources import views as V

RUNNING = r"^translating (\d+)/(\d+)"
# Phrases of a translation that tell its style, by key, the first that occurs counts.
STYLE = {"pronoun_we": ("chúng tôi", "chúng ta"), "paper": ("bài báo", "bài viết", "nghiên cứu"), "method": ("phương pháp", "cách tiếp cận"), "result": ("kết quả", "hiệu suất")}
#: Characters of a text that a log keeps.
LOGGED = 4_000


def counters(status: Column, translated: Column) -> Column:
    """(current, total) out of ``translating i/n``; else the chunks translated, of 0."""
    part = lambda k: F.regexp_extract(status, r"^translating (\d+)/(\d+)$", k).try_cast("int")
    return F.struct(F.coalesce(part(1), translated.cast("int")).alias("current"), F.coalesce(part(2), F.lit(0)).alias("total"))


def status_view(progress: DataFrame) -> DataFrame:
    """(job_id, status, current_chunk, total_chunks, progress_percent, failed_chunks, title): what a client sees; null where nothing is known."""
    s = F.coalesce("status", F.lit("pending"))
    part = lambda k: F.regexp_extract(s, RUNNING, k).try_cast("int")
    percent = F.when(s.isin("done", "done_with_warnings"), 100).when(part(2) > 0, F.bround(part(1) / part(2) * 100).cast("int")).when(part(2) == 0, 0)
    failed = F.coalesce(F.size("failed_chunks"), F.lit(0))
    return progress.select("job_id", s.alias("status"), part(1).alias("current_chunk"), part(2).alias("total_chunks"), percent.alias("progress_percent"), F.when(failed > 0, failed).alias("failed_chunks"), F.nullif("title", F.lit("")).alias("title"))


def crashed(progress: DataFrame) -> DataFrame:
    """Runs with failed chunks or retries, as findings."""
    n = F.coalesce(F.size("failed_chunks"), F.lit(0))
    again = F.coalesce(F.col("status").contains("retrying"), F.lit(False)) | (F.coalesce("retry_count", F.lit(0)) > 0)
    none = F.array().cast(progress.schema["failed_chunks"].dataType)
    return progress.where((n > 0) | again).select("job_id", F.lit("BROWSER_CRASH").alias("cause"), F.when(n >= 3, "critical").otherwise("warning").alias("severity"), F.when(n > 0, 0.85).otherwise(0.55).alias("confidence"), F.coalesce("failed_chunks", none).alias("affected"))


def visible(roots: list[DataFrame]) -> DataFrame:
    """Jobs of all roots, those of the first root that has a name."""
    every = None
    for i, r in enumerate(roots):
        r = r.withColumn("root", F.lit(i))
        every = r if every is None else every.unionByName(r)
    best = F.row_number().over(Window.partitionBy("job_id").orderBy("root"))
    return every.withColumn("__r", best).where("__r = 1").drop("__r")


def located(asked: DataFrame, own: DataFrame, legacy: DataFrame) -> DataFrame:
    """``asked`` (job_id, owner, allow_legacy) with ``path``: the owner's, else a legacy one where allowed, else null."""
    j = asked.join(own.select("job_id", "owner", F.col("path").alias("__own")), ["job_id", "owner"], "left").join(legacy.select("job_id", F.col("path").alias("__old")), "job_id", "left")
    return j.withColumn("path", F.coalesce("__own", F.when(F.col("allow_legacy"), F.col("__old")))).drop("__own", "__old")


def earlier_runs(uploads: DataFrame, progress: DataFrame) -> DataFrame:
    """(upload, job_id): runs of the same document as an upload (upload, base_job_id, title, page_count).

    By base id, the start of the run's id or the base that it names, or by title and
    number of pages; title and pages count only where both are given.
    """
    u = uploads.select("upload", F.col("base_job_id").alias("__base"), F.lower(T.strip(F.col("title"))).alias("__title"), F.coalesce("page_count", F.lit(0)).alias("__pages"))
    p = progress.withColumns({"__t": F.lower(T.strip(F.coalesce("title", F.lit("")))), "__p": F.coalesce("page_count", F.lit(0))})
    stem = p.withColumn("__stem", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("job_id", "_"))), lambda n: F.array_join(F.slice(F.split("job_id", "_"), F.lit(1), n), "_"))))
    named = u.where("__base <> ''")
    by_base = named.join(stem, F.col("__base") == F.col("__stem")).select("upload", "job_id")
    by_name = named.join(p, F.col("__base") == F.col("base_job_id")).select("upload", "job_id")
    by_title = u.where("__title <> '' and __pages > 0").join(p, (F.col("__title") == F.col("__t")) & (F.col("__pages") == F.col("__p"))).select("upload", "job_id")
    return by_base.unionByName(by_name).unionByName(by_title).distinct()


def existing_pdf(asked: DataFrame, progress: DataFrame) -> DataFrame:
    """``asked`` (upload, title, page_count, owner, is_admin, exclude) with ``job_id``: an earlier run of the same paper, or null.

    ``progress`` has job_id, owner (null for the shared folder), title and page_count.  A
    run counts if its id begins with pdf_ and isn't the excluded one, it is the owner's or,
    for an admin, shared, and the title, letter case aside, and the number of pages agree;
    both sides need them.  The owner's come before shared ones, then the least id.
    """
    name = lambda c: F.lower(T.strip(F.coalesce(c, F.lit(""))))
    a = asked.select("upload", name(F.col("title")).alias("__t"), F.col("page_count").alias("__p"), "owner", "is_admin", F.coalesce("exclude", F.lit("")).alias("__x")).where("__t <> '' and __p > 0")
    p = progress.where(F.col("job_id").startswith("pdf_") & (F.col("page_count") > 0)).select("job_id", F.col("owner").alias("__o"), name(F.col("title")).alias("__t"), F.col("page_count").alias("__p")).where("__t <> ''")
    mine = a.join(p, ["__t", "__p"]).where((F.col("job_id") != F.col("__x")) & ((F.col("__o") == F.col("owner")) | (F.col("__o").isNull() & F.col("is_admin"))))
    found = mine.groupBy("upload").agg(F.min(F.struct(F.col("__o").isNull().alias("shared"), "job_id")).alias("__best"))
    return asked.join(found, "upload", "left").withColumn("job_id", F.col("__best.job_id")).drop("__best")


def imported(jobs: DataFrame, progress: DataFrame, owner: str) -> DataFrame:
    """``jobs`` and those of ``progress`` that it lacks, as ``owner``'s."""
    fresh = progress.join(jobs.select("job_id"), "job_id", "left_anti").dropDuplicates(["job_id"]).withColumn("owner", F.lit(owner))
    return jobs.unionByName(fresh.select(*[c for c in jobs.columns if c in fresh.columns]), allowMissingColumns=True)


def with_columns(table: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """``table`` with every wanted column: those that it lacks are null."""
    return table.select("*", *(F.lit(None).cast(t).alias(c) for c, t in wanted.items() if c not in table.columns))


def reconciled(state: DataFrame, disk: DataFrame) -> DataFrame:
    """The translated chunks of a run's state (job_id, chunk, text) and, of those on disk that aren't blank, what it lacks."""
    lost = disk.where(T.strip(F.coalesce("text", F.lit(""))) != "").join(state.select("job_id", "chunk"), ["job_id", "chunk"], "left_anti")
    return state.withColumn("source", F.lit("state")).unionByName(lost.select("job_id", "chunk", "text").withColumn("source", F.lit("disk")))


def synthesised(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """``chunks`` (job_id, chunk, mt) with the final text of ``segments`` (job_id, chunk, verdict, synthesis_used, final) and whether it ``changed``.

    Segments in consensus that used no synthesis, and those without a final text, change nothing.
    """
    good = segments.where((F.coalesce("synthesis_used", F.lit(False)) | ~F.col("verdict").eqNullSafe("consensus")) & (F.coalesce("final", F.lit("")) != ""))
    j = chunks.join(good.select("job_id", "chunk", F.col("final").alias("__f")), ["job_id", "chunk"], "left")
    return j.withColumns({"mt": F.coalesce("__f", "mt"), "changed": F.col("__f").isNotNull()}).drop("__f")


def style_profile(chunks: DataFrame, phrases: dict[str, tuple[str, ...]] = STYLE) -> DataFrame:
    """(conv_id, key, phrase): of each document's translations (conv_id, idx, mt) the latest phrase for each key."""
    low = F.lower("mt")
    found = lambda words: F.coalesce(*(F.when(low.contains(w), F.lit(w)) for w in words))
    said = F.array(*(F.struct(F.lit(k).alias("key"), found(w).alias("phrase")) for k, w in phrases.items()))
    return chunks.select("conv_id", "idx", F.inline(said)).where("phrase is not null").groupBy("conv_id", "key").agg(F.max_by("phrase", "idx").alias("phrase"))


def memory_rollup(decisions: DataFrame) -> DataFrame:
    """(conv_id, size, chunk_indexes, key_terms): what a run keeps of its memory; key terms only where there are any."""
    terms = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.size("key_terms") > 0, F.struct(F.col("idx").cast("string"), "key_terms")))))
    return decisions.groupBy("conv_id").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("idx")).alias("chunk_indexes"), terms.alias("key_terms"))


def discoveries(chunks: DataFrame, every: int = 5, least: int = 300) -> DataFrame:
    """The chunks (conv_id, idx, src) at which new terms are looked for: every fifth of a document, if it is long enough."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("idx"))
    return chunks.withColumn("n", n).where((F.col("n") % every == 0) & (F.length("src") >= least))


def style_owner(log: DataFrame) -> DataFrame:
    """(job_id, model): the model of each run's latest success in ``log`` (job_id, model, ok, seq)."""
    return log.where("ok").groupBy("job_id").agg(F.max_by("model", "seq").alias("model"))


def handoff_anchor(examples: Column, chunk: Column, from_model: Column, to_model: Column, most: int = 700) -> Column:
    """What one model hands to another: the pairs (s, t) before a chunk, numbered, cut to ``most`` characters a side, and between whom; null without any text."""
    side = lambda f: F.left(F.array_join(F.transform(examples, lambda x, i: F.concat(F.lit("[handoff "), i + 1, F.lit("] "), x[f])), "\n\n"), F.lit(most))
    en, vi = side("s"), side("t")
    anchor = F.struct(en.alias("en"), vi.alias("vi"), from_model.alias("from_model"), to_model.alias("to_model"), chunk.alias("chunk_index"), F.lit("cross_model_style_handoff").alias("reason"))
    return F.when((F.size(examples) > 0) & (T.strip(en) != "") & (T.strip(vi) != ""), anchor)


def merged_anchors(rows: DataFrame) -> DataFrame:
    """``rows`` (base, handoff), two anchors with en and vi of which either may be null, with ``merged``.

    Without a hand-over it is the base, without a base the hand-over; else the base with
    both texts in turn and the hand-over inside.  It has the base's fields and ``handoff``.
    """
    own = rows.schema["base"].dataType.names
    given = rows.schema["handoff"].dataType.names
    kind = rows.schema["base"].dataType
    both = lambda f: F.array_join(F.filter(F.array(F.col("base")[f], F.col("handoff")[f]), lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n")
    none = F.lit(None).cast(rows.schema["handoff"].dataType)
    base = F.struct(*(F.col("base")[c].alias(c) for c in own), none.alias("handoff"))
    alone = F.struct(*((F.col("handoff")[c] if c in given else F.lit(None)).cast(kind[c].dataType).alias(c) for c in own), none.alias("handoff"))
    merged = F.struct(*((both(c) if c in ("en", "vi") else F.col("base")[c]).alias(c) for c in own), F.col("handoff").alias("handoff"))
    return rows.withColumn("merged", F.when(F.col("handoff").isNull(), F.when(F.col("base").isNotNull(), base)).when(F.col("base").isNull(), alone).otherwise(merged))


def critique_text(errors: DataFrame) -> DataFrame:
    """(conv_id, text): the errors (conv_id, idx, pos, category, severity) of each document's blocks as lines, by block."""
    lines = errors.groupBy("conv_id", "idx").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("- "), "severity", F.lit(" "), "category").alias("line")))).alias("e"))
    block = F.concat_ws("\n", F.format_string("Block [%d]:", F.col("idx") + 1), F.array_join(F.transform("e", lambda x: x["line"]), "\n"))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", block.alias("b")))), lambda x: x["b"]), "\n").alias("text"))


def block_map(blocks: DataFrame) -> DataFrame:
    """(doc_id, chunks): the boxes (doc_id, chunk, block_idx, page_num, x0, y0, x1, y1) of each chunk's blocks, chunk by chunk."""
    inner = blocks.groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("block_idx", "page_num", "x0", "y0", "x1", "y1"))).alias("blocks"))
    return inner.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "blocks"))), lambda c: c["blocks"]).alias("chunks"))


def for_log(text: Column) -> Column:
    """A text as a log keeps it."""
    n = F.length(text)
    return F.when(n > LOGGED, F.concat(F.left(text, F.lit(LOGGED)), F.lit("...[truncated "), n.cast("string"), F.lit(" chars]"))).otherwise(text)


def sanitised(value: Column, kind: DataType) -> Column:
    """``value`` of type ``kind`` with every text in it as a log keeps it; keys of maps stay."""
    if isinstance(kind, StringType):
        return for_log(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: sanitised(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: sanitised(x, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*(sanitised(value[f.name], f.dataType).alias(f.name) for f in kind)))
    return value


def iso(ts: Column) -> Column:
    """A time as UTC text to the microsecond; the session's time zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def progress(spark, d) -> DataFrame:
    """Orders as progress: the chunks that failed are the line items returned."""
    j = relational.jobs(spark, d)
    failed = V.table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("failed_chunks"))
    status = F.when(F.col("job_id") % 9 == 0, "retrying").when(F.col("job_id") % 4 == 0, F.concat(F.lit("translating "), F.col("job_id") % 7, F.lit("/"), F.col("job_id") % 11)).otherwise(F.col("status"))
    return j.join(failed, "job_id", "left").select("job_id", status.alias("status"), "failed_chunks", (F.col("job_id") % 3).cast("int").alias("retry_count"), "title", "owner")


def _segments(spark, d) -> DataFrame:
    c = _parts(spark, d)
    return c.where("part % 3 = 0").select("job_id", "chunk", F.when(F.col("part") % 2 == 0, "consensus").otherwise("mild").alias("verdict"), (F.col("part") % 5 == 0).alias("synthesis_used"), F.when(F.col("part") % 7 != 0, F.concat(F.lit("final "), "part")).otherwise("").alias("final"))


def _parts(spark, d) -> DataFrame:
    """Each part of a job once, as a chunk."""
    return relational.chunks(spark, d).select("job_id", F.col("part").alias("chunk"), "part").distinct()


def _texts(spark, d) -> DataFrame:
    return _parts(spark, d).select("job_id", "chunk", F.concat(F.lit("mt "), "part").alias("mt"))


def _block_map(spark, d) -> DataFrame:
    b = geometry.boxes(spark, d).select(F.col("page_num").alias("doc_id"), (F.col("block_idx") % 3).alias("chunk"), "block_idx", (F.col("block_idx") % 2).alias("page_num"), "x0", "y0", "x1", "y1")
    return block_map(b).select("doc_id", F.transform("chunks", lambda c: F.transform(c, lambda x: x["block_idx"])).alias("chunks"))


_WORDS = {"article": ("the", "a"), "link": ("and", "or"), "place": ("in", "on")}
QUERIES = {
    "job_status": lambda spark, d: status_view(progress(spark, d)),
    "job_counters": lambda spark, d: progress(spark, d).select("job_id", counters(F.col("status"), F.coalesce(F.size("failed_chunks"), F.lit(0))).alias("c")).select("job_id", "c.*"),
    "job_crashes": lambda spark, d: crashed(progress(spark, d)),
    "job_visible": lambda spark, d: visible([relational.jobs(spark, d).where("job_id % 5 <> 0").select("job_id", "owner", "title"), relational.jobs(spark, d).where("job_id % 3 <> 0").select("job_id", F.lit(None).cast("long").alias("owner"), "title")]),
    "job_imported": lambda spark, d: imported(relational.jobs(spark, d).where("job_id % 2 = 0").select("job_id", F.col("owner").cast("string"), "status"), progress(spark, d).select("job_id", "status"), "admin"),
    "job_reconciled": lambda spark, d: reconciled(_texts(spark, d).where("chunk % 2 = 0").withColumnRenamed("mt", "text"), _texts(spark, d).where("chunk % 3 <> 0").withColumnRenamed("mt", "text")),
    "job_synthesised": lambda spark, d: synthesised(_texts(spark, d), _segments(spark, d)),
    "block_map": _block_map,
    "job_one": lambda spark, d: relational.jobs(spark, d).where("job_id = 7"),
    "job_chunks": lambda spark, d: relational.chunks(spark, d).where("job_id = 7").orderBy("chunk"),
    "user_count": lambda spark, d: V.table(spark, d, "customer").agg(F.count("*").alias("users")),
    "style_profile": lambda spark, d: style_profile(V.pairs(spark, d), _WORDS),
    "term_discovery": lambda spark, d: discoveries(V.pairs(spark, d), least=60).select("conv_id", "idx", "n"),
    "style_owner": lambda spark, d: style_owner(V.table(spark, d, "events").select((F.col("user_id") % 50).alias("job_id"), F.col("event_type").alias("model"), (F.col("value") >= 30).alias("ok"), F.col("event_id").alias("seq"))),
}

_P = """p as (select o_orderkey as job_id, case when o_orderkey % 9 = 0 then 'retrying' when o_orderkey % 4 = 0 then 'translating ' || o_orderkey % 7 || '/' || o_orderkey % 11
  when o_orderstatus = 'O' then 'translating 3/10' when o_orderstatus = 'F' then 'done' else 'error: stopped' end as status, f as failed_chunks, (o_orderkey % 3)::int as retry_count, o_orderpriority as title
  from orders left join (select l_orderkey, list(l_linenumber order by l_linenumber) as f from lineitem where l_returnflag = 'R' group by 1) on l_orderkey = o_orderkey)"""
_N = lambda k: f"try_cast(nullif(regexp_extract(status, '^translating ([0-9]+)/([0-9]+)', {k}), '') as int)"
_STYLE = " union all ".join(f"select conv_id, idx, '{k}' as key, case {' '.join(f'when contains(lower(mt), {chr(39)}{w}{chr(39)}) then {chr(39)}{w}{chr(39)}' for w in ws)} end as phrase from {V.SQL_PAIRS}" for k, ws in _WORDS.items())
ORACLE_SQL = {
    "job_status": f"with {_P} select job_id, status, {_N(1)} as current_chunk, {_N(2)} as total_chunks, case when status in ('done', 'done_with_warnings') then 100 when {_N(2)} > 0 then round_even({_N(1)}::double / {_N(2)} * 100, 0)::int when {_N(2)} = 0 then 0 end as progress_percent, nullif(coalesce(len(failed_chunks), 0), 0)::int as failed_chunks, title from p",
    "job_counters": f"with {_P} select job_id, coalesce({_N(1)}, coalesce(len(failed_chunks), 0))::int as current, coalesce({_N(2)}, 0) as total from p",
    "job_crashes": f"with {_P} select job_id, 'BROWSER_CRASH' as cause, case when len(failed_chunks) >= 3 then 'critical' else 'warning' end as severity, case when len(failed_chunks) > 0 then 0.85 else 0.55 end::double as confidence, coalesce(failed_chunks, []) as affected from p where len(failed_chunks) > 0 or status = 'retrying' or retry_count > 0",
    "job_visible": "select o_orderkey as job_id, case when o_orderkey % 5 <> 0 and o_custkey % 7 <> 0 then o_custkey end as owner, o_orderpriority as title, case when o_orderkey % 5 <> 0 then 0 else 1 end::int as root from orders where o_orderkey % 5 <> 0 or o_orderkey % 3 <> 0",
    "job_imported": f"with {_P} select job_id, case when job_id % 2 = 0 then case when o_custkey % 7 <> 0 then o_custkey::varchar end else 'admin' end as owner, case when job_id % 2 = 0 then case o_orderstatus when 'O' then 'translating 3/10' when 'F' then 'done' else 'error: stopped' end else status end as status from p join orders on o_orderkey = job_id",
    "job_reconciled": "select distinct l_orderkey as job_id, l_partkey as chunk, 'mt ' || l_partkey as text, case when l_partkey % 2 = 0 then 'state' else 'disk' end as source from lineitem where l_partkey % 2 = 0 or l_partkey % 3 <> 0",
    "job_synthesised": """select distinct l_orderkey as job_id, l_partkey as chunk, case when c then 'final ' || l_partkey else 'mt ' || l_partkey end as mt, c as changed
from (select *, l_partkey % 3 = 0 and (l_partkey % 5 = 0 or l_partkey % 2 <> 0) and l_partkey % 7 <> 0 as c from lineitem)""",
    "block_map": "select l_orderkey as doc_id, list(i order by c) as chunks from (select l_orderkey, n % 3 as c, list(n order by n) as i from (select l_orderkey, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity))::int as n from lineitem) group by 1, 2) group by 1",
    "job_one": "select o_orderkey as job_id, case when o_custkey % 7 <> 0 then o_custkey end as owner, case o_orderstatus when 'O' then 'translating 3/10' when 'F' then 'done' else 'error: stopped' end as status, o_totalprice as score, strftime(o_orderdate, '%Y-%m-%d') as updated_at, o_orderpriority as title from orders where o_orderkey = 7",
    "job_chunks": "select l_orderkey as job_id, l_linenumber as chunk, l_partkey as part, l_quantity as quantity, (l_returnflag = 'R')::int as edited from lineitem where l_orderkey = 7",
    "user_count": "select count(*) as users from customer",
    "style_profile": f"select conv_id, key, arg_max(phrase, idx) as phrase from ({_STYLE}) where phrase is not null group by 1, 2",
    "term_discovery": f"select conv_id, idx, n from (select *, row_number() over (partition by conv_id order by idx) as n from {V.SQL_PAIRS}) where n % 5 = 0 and length(src) >= 60",
    "style_owner": "select user_id % 50 as job_id, arg_max(event_type, event_id) as model from events where value >= 30 group by 1",
}
