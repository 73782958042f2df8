"""Small keyed decisions: statuses, selectors, style owners, progress, plans and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions.text import strip
from vellum.operators.progress import key_parts
from vellum.sources import views as V

RUNNING = r"^(starting|extracting|translating|judging|rebuilding|retrying)"


# Statuses of runs that are over, and how others begin; ids of jobs; addresses and words of a text; letters and characters under which a text is too short.
TERMINAL, TERMINAL_BEGIN = ("done", "done_with_warnings", "cancelled", "superseded"), ("error", "compile_error")
JOB_ID = r"^[A-Za-z0-9._-]{1,128}\z"
ADDRESS = r"(?i)\b(?:https?://|www\.)\S+|\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b|\bdoi:\s*\S+|\b10\.\d{4,9}/\S+"
LETTERS, FEW_LETTERS, FEW_CHARS = "[A-Za-zÀ-ỹ]{2,}", 8, 40


def is_terminal(status: Column) -> Column:
    s = strip(status)
    return s.isin(*TERMINAL) | F.regexp_like(s, F.lit(f"^({'|'.join(TERMINAL_BEGIN)})"))


def is_job_id(job_id: Column) -> Column:
    """Letters, digits, dots, underscores and hyphens, 128 at most, and not the folder above."""
    return F.coalesce(job_id.rlike(JOB_ID) & (job_id != ".."), F.lit(False))


def is_chunk_key(key: Column) -> Column:
    """``12`` or ``input:<path>:12``, as ``progress.key_parts`` takes them."""
    return key_parts(key).isNotNull()


def upload_kind(name: Column) -> Column:
    low = F.lower(name)
    kinds = (("pdf", r"\.pdf$"), ("docx", r"\.docx$"), ("latex", r"\.(tex|zip|tar\.gz|tgz)$"), ("text", r"\.(md|markdown|txt)$"), ("html", r"\.html?$"))
    out = F.lit("unknown")
    for kind, pattern in kinds[::-1]:
        out = F.when(low.rlike(pattern), kind).otherwise(out)
    return out


def bypass_reason(text: Column) -> Column:
    """Why a text needs no model: empty, nothing but addresses, or under eight letters of words in at most 40 characters."""
    raw = strip(text)
    rest = F.regexp_replace(raw, ADDRESS, " ")
    letters = F.length(F.array_join(F.regexp_extract_all(rest, F.lit(LETTERS), F.lit(0)), ""))
    return F.when(raw == "", "empty").when(strip(rest) == "", "url_only").when((letters < FEW_LETTERS) & (F.length(raw) <= FEW_CHARS), "too_short")


def output_issues(pages_in: Column, pages_out: Column, size_in: Column, size_out: Column) -> Column:
    """What three validators say about an output, each with limits of its own."""
    r = size_out / size_in
    return F.filter(
        F.array(
            F.when((pages_in != pages_out) | (r < 0.3), F.lit("strict")),
            F.when((pages_out < pages_in * 0.5) | ((pages_out <= 2) & (pages_in > 5)) | (r < 0.2), F.lit("loose")),
            F.when((pages_in != pages_out) | (r < 0.3) | (r > 5.0), F.lit("proofread")),
        ),
        lambda x: x.isNotNull(),
    )


def selectors(log: DataFrame, keep: int = 8) -> DataFrame:
    """Selectors of each backend by hits less twice the failures; those at -3 or less go, the best ``keep`` stay.

    ``log`` has backend, selector, ok and seq; failures before a selector's first success don't count.
    """
    first = log.where("ok").groupBy("backend", "selector").agg(F.min("seq").alias("__first"))
    counted = log.join(first, ["backend", "selector"]).where("seq >= __first")
    g = counted.groupBy("backend", "selector").agg((F.sum(F.col("ok").cast("int")) - 2 * F.sum((~F.col("ok")).cast("int"))).alias("score")).where("score > -3")
    rank = F.row_number().over(Window.partitionBy("backend").orderBy(F.desc("score"), "selector"))
    return g.withColumn("rank", rank).where(F.col("rank") <= keep)


def latest_phases(log: DataFrame) -> DataFrame:
    """The latest entry of each job and phase, in the place of the first."""
    g = log.groupBy("job_id", "phase").agg(F.max(F.struct("seq", "value")).alias("last"), F.min("seq").alias("place"))
    return g.select("job_id", "phase", "last.seq", "last.value", "place")


def sections_of_chunks(chunks: DataFrame, sections: DataFrame, scale: int = 100) -> DataFrame:
    """Each chunk's section: the last one that starts at or before ``scale`` times its index."""
    both = chunks.withColumn("at", F.col("chunk") * scale).select("doc_id", "chunk", "at", F.lit(None).cast("long").alias("section"))
    starts = sections.select("doc_id", F.lit(None).cast("long").alias("chunk"), F.col("first").cast("long").alias("at"), F.col("section").cast("long").alias("section"))
    w = Window.partitionBy("doc_id").orderBy("at", F.when(F.col("section").isNotNull(), 0).otherwise(1), "section").rowsBetween(Window.unboundedPreceding, 0)
    return both.unionByName(starts).withColumn("section", F.last("section", ignorenulls=True).over(w)).where("chunk is not null").select("doc_id", "chunk", "section")


def handoff(asked: DataFrame, anchors: DataFrame) -> DataFrame:
    """The anchor of a chunk and model, or else the model's general one (chunk null)."""
    own = anchors.where("chunk is not null").select("chunk", "model", F.col("anchor").alias("a"))
    general = anchors.where("chunk is null").select("model", F.col("anchor").alias("b"))
    return asked.join(own, ["chunk", "model"], "left").join(general, "model", "left").select("chunk", "model", F.coalesce("a", "b").alias("anchor"))


def low_quality(rows: DataFrame, threshold: float, most: int | None = None, tie: str | None = None) -> DataFrame:
    """The rows under the threshold, or all if there are none; no score counts as 100.

    With ``most``, only that many of the lowest scores, of equal ones the lesser ``tie`` first.
    """
    scored = rows.withColumn("__s", F.coalesce("score", F.lit(100.0)))
    if most is None:
        any_low = scored.agg(F.coalesce(F.bool_or(F.col("__s") < threshold), F.lit(False)).alias("__low"))
        return scored.join(F.broadcast(any_low)).where(~F.col("__low") | (F.col("__s") < threshold)).drop("__s", "__low")
    # rows under the threshold are lower than all others: if there are any, the others only have to go
    first = scored.orderBy("__s", tie).limit(most).withColumn("__low", F.bool_or(F.col("__s") < threshold).over(Window.partitionBy(F.lit(1))))
    return first.where(~F.col("__low") | (F.col("__s") < threshold)).drop("__s", "__low")


def environment_counts(lines: DataFrame) -> DataFrame:
    """Environments whose begins and ends differ in number, comment lines aside; ``lines`` has doc_id and text."""
    t = lines.where(~F.trim("text").startswith("%"))
    n = lambda kind: t.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"\\{kind}\{{([^}}]+)\}}"), F.lit(1))).alias("env")).groupBy("doc_id", "env").agg(F.count("*").alias(kind))
    both = n("begin").join(n("end"), ["doc_id", "env"], "full_outer")
    return both.select("doc_id", "env", F.coalesce("begin", F.lit(0)).alias("begin"), F.coalesce("end", F.lit(0)).alias("end")).where("begin <> end")


def model_advice(attempts: DataFrame) -> DataFrame:
    """Attempts, failures and failure share by model, best first; ``attempts`` has model and ok."""
    return attempts.groupBy("model").agg(F.count("*").alias("attempts"), F.sum((~F.col("ok")).cast("int")).alias("failures"), F.round(F.avg((~F.col("ok")).cast("int")), 6).alias("share"))


def cache_read(cache: DataFrame, now: float) -> DataFrame:
    return cache.where(F.col("expires_at") > now)


def _events(spark, d) -> DataFrame:
    return V.table(spark, d, "events").select((F.col("user_id") % 50).alias("job_id"), F.col("event_type").alias("phase"), F.col("event_id").alias("seq"), "value", F.concat(F.lit("s"), (F.col("event_id") % 12).cast("string")).alias("selector"), (F.col("event_id") % 9 != 0).alias("ok"), F.col("event_type").alias("backend"))


#: Endings that pages' addresses get by rule, so that there are uploads of every kind.
ENDINGS = ("", ".pdf", ".DOCX", ".tex", ".zip", ".tar.gz", ".tgz", ".md", ".markdown", ".txt", ".htm")
QUERIES = {
    "latest_phases": lambda spark, d: latest_phases(_events(spark, d)),
    "selector_ranks": lambda spark, d: selectors(_events(spark, d)),
    "model_advice": lambda spark, d: model_advice(_events(spark, d).withColumnRenamed("phase", "model").drop("backend")),
    "low_quality_pairs": lambda spark, d: low_quality(V.table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("score")), 20_000.0),
    "bypass_blocks": lambda spark, d: V.blocks(spark, d).select(bypass_reason(F.col("text")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")),
    "output_validation": lambda spark, d: V.table(spark, d, "lineitem").select(F.explode(output_issues(F.col("l_linenumber"), F.col("l_quantity").cast("int") % 7 + 1, F.col("l_extendedprice"), F.col("l_quantity") * 500)).alias("issue")).groupBy("issue").agg(F.count("*").alias("n")),
    "page_kinds": lambda spark, d: V.table(spark, d, "pages").select(upload_kind(F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % len(ENDINGS) + 1).cast("int")))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n")),
    "language_selection": lambda spark, d: V.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.max(F.struct("n_chars", F.expr("-doc_id")))["n_chars"].alias("longest")),
}

_E = "e as (select user_id % 50 as job_id, event_type as phase, event_id as seq, value, 's' || (event_id % 12) as selector, event_id % 9 <> 0 as ok, event_type as backend from events)"
ORACLE_SQL = {
    "latest_phases": f"with {_E} select job_id, phase, max(seq) as seq, arg_max(value, seq) as value, min(seq) as place from e group by 1, 2",
    "selector_ranks": f"""with {_E}, f as (select *, min(seq) filter (ok) over (partition by backend, selector) as first from e), g as (select backend, selector, count(*) filter (ok) - 2 * count(*) filter (not ok) as score from f where seq >= first group by 1, 2)
select * from (select *, row_number() over (partition by backend order by score desc, selector) as rank from g where score > -3) where rank <= 8""",
    "model_advice": f"with {_E} select phase as model, count(*) as attempts, count(*) filter (not ok) as failures, round(avg((not ok)::int), 6) as share from e group by 1",
    "low_quality_pairs": "select o_orderkey, o_totalprice as score from orders where o_totalprice < 20000 or not exists (select 1 from orders where o_totalprice < 20000)",
    "bypass_blocks": f"""with b as (select trim(text) as raw, regexp_replace(trim(text), '{ADDRESS}', ' ', 'g') as rest from {V.SQL_BLOCKS}),
r as (select case when raw = '' then 'empty' when trim(rest) = '' then 'url_only' when length(array_to_string(regexp_extract_all(rest, '{LETTERS}'), '')) < {FEW_LETTERS} and length(raw) <= {FEW_CHARS} then 'too_short' end as reason from b)
select reason, count(*) as n from r group by 1""",
    "output_validation": """with l as (select l_linenumber as a, trunc(l_quantity)::int % 7 + 1 as b, l_quantity * 500 / l_extendedprice as r from lineitem)
select issue, count(*) as n from (select 'strict' as issue from l where a <> b or r < 0.3 union all select 'loose' from l where b < a * 0.5 or (b <= 2 and a > 5) or r < 0.2 union all select 'proofread' from l where a <> b or r < 0.3 or r > 5.0) group by 1""",
    "page_kinds": rf"""select case when regexp_matches(u, '\.pdf$') then 'pdf' when regexp_matches(u, '\.docx$') then 'docx' when regexp_matches(u, '\.(tex|zip|tar\.gz|tgz)$') then 'latex'
  when regexp_matches(u, '\.(md|markdown|txt)$') then 'text' when regexp_matches(u, '\.html?$') then 'html' else 'unknown' end as kind, count(*) as n
from (select lower(regexp_replace(url, '[?#].*$', '') || ({list(ENDINGS)})[page_id % {len(ENDINGS)} + 1]) as u from pages) group by 1""",
    "language_selection": "select lang, count(*) as n, sum(n_chars) as n_chars, max(n_chars) as longest from documents group by 1",
}
