"""Segmentation: greedy packing of blocks, sections, carried headings, neighbours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vellum.functions import text as X
from vellum.sources import views as V

SOFT, HARD = 1500, 2200
#: What closes a sentence, for packing.
STOP = r'[.!?;:]\s*[")]?$'


def greedy(lengths: list[int], target: int) -> list[int]:
    """Chunk of each block: a chunk closes when the next block would pass the target and it isn't empty."""
    out, chunk, size, filled = [], 0, 0, False
    for n in lengths:
        if filled and size + n > target:
            chunk, size = chunk + 1, 0
        out.append(chunk)
        size, filled = size + n, True
    return out


def bounded(lengths: list[int], stops: list[bool], headers: list[bool], soft: int = SOFT, hard: int = HARD) -> list[int]:
    """Packing that closes at the hard limit, past the soft one after a sentence, and before a header once half full."""
    out, chunk, size, prev = [], 0, 0, None
    for i, n in enumerate(lengths):
        if prev is not None and ((headers[i] and size > soft * 0.5) or size + n > hard or (size + n > soft and stops[prev])):
            chunk, size = chunk + 1, 0
        out.append(chunk)
        size, prev = size + n, i
    return out


def pack_column(target: int):
    """Array of lengths -> array of chunk numbers; sequential within a document, so an Arrow function."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def pack(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda x: greedy(list(x), target))

    return pack


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def pack_bounded(lengths: pd.Series, stops: pd.Series, headers: pd.Series) -> pd.Series:
    return pd.Series([bounded(list(a), list(b), list(c)) for a, b, c in zip(lengths, stops, headers, strict=True)])


def is_header(line: Column, size: Column | None = None, bold: Column | None = None, usual: float = 10.0) -> Column:
    """Lines that are numbered, named like a section, or (for plain text) start with ``#``: under 60 characters or, up to 100, bold or a tenth larger than usual; and other bold ones of under 80 that are larger by 0.15."""
    s = F.trim(line)
    named = s.rlike(r"^[0-9]+(\.[0-9]+)*\.?\s+[A-Z][\w\s\-:&,]+$") | s.rlike(r"(?i)^(Abstract|Introduction|Background|Related Work|Methodology|Methods?|Approach|Experiments?|Experimental|Results?|Discussion|Conclusions?|References|Appendix|Acknowledgments?)\b") | s.startswith("#")
    short = named & (F.length(s) < 60)
    if size is None and bold is None:
        return (s != "") & short
    heavy, large = F.coalesce(bold if bold is not None else F.lit(False), F.lit(False)), F.coalesce(size if size is not None else F.lit(0.0), F.lit(0.0))
    told = short | (named & (heavy | (large >= usual * 1.1))) | (heavy & (large >= usual * 1.15) & (F.length(s) < 80))
    return (s != "") & (F.length(line) <= 100) & told


def chunked(docs: DataFrame, target: int = 3500) -> DataFrame:
    """(doc_id, block_idx, chunk, n_chars): lines of each document packed greedily."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    each = docs.select("doc_id", F.transform(lines, lambda x: F.length(x)).alias("n"))
    each = each.withColumn("c", pack_column(target)("n"))
    return each.select("doc_id", F.posexplode(F.arrays_zip("c", "n")).alias("block_idx", "x")).select("doc_id", "block_idx", F.col("x.c").alias("chunk"), F.col("x.n").alias("n_chars"))


def planned(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk, first, blocks, n_chars) with soft and hard limits, sentences and section starts."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    each = docs.select("doc_id", F.transform(lines, lambda x: F.length(x)).alias("n"), F.transform(lines, lambda x: (x == "") | F.rtrim(x).rlike(STOP)).alias("s"), F.transform(lines, lambda x: is_header(x)).alias("h"))
    each = each.select("doc_id", F.posexplode(F.arrays_zip(pack_bounded("n", "s", "h").alias("c"), F.col("n"))).alias("block_idx", "x"))
    return each.groupBy("doc_id", F.col("x.c").alias("chunk")).agg(F.min("block_idx").alias("first"), F.count("*").alias("blocks"), F.sum("x.n").alias("n_chars"))


def chunk_texts(blocks: DataFrame, size: int = 10) -> DataFrame:
    """Numbered texts of every ``size`` lines: ``[i] line`` joined by blank lines."""
    line = F.concat(F.lit("["), F.col("block_idx").cast("string"), F.lit("] "), F.array_join(X.tokens(F.col("text")), " "))
    g = blocks.groupBy("doc_id", F.floor(F.col("block_idx") / size).alias("part")).agg(F.array_sort(F.collect_list(F.struct("block_idx", line.alias("line")))).alias("l"))
    return g.select("doc_id", "part", F.md5(F.array_join(F.col("l.line"), "\n\n").cast("binary")).alias("digest"), F.size("l").alias("blocks"))


def sections(blocks: DataFrame) -> DataFrame:
    """Runs of lines from one header to the next; lines before the first header form section 0."""
    order = Window.partitionBy("doc_id").orderBy("block_idx")
    head = is_header(F.col("text"))
    each = blocks.withColumn("h", head.cast("int")).withColumn("section", F.sum("h").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return each.groupBy("doc_id", "section").agg(F.min("block_idx").alias("first"), F.max("block_idx").alias("last"), F.count("*").alias("blocks"))


def carried_headings(blocks: DataFrame) -> DataFrame:
    """How many lines stand under each heading, by document."""
    order = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    under = F.last(F.when(is_header(F.col("text")), F.trim("text")), ignorenulls=True).over(order)
    return blocks.select("doc_id", F.coalesce(under, F.lit("")).alias("heading")).groupBy("doc_id", "heading").agg(F.count("*").alias("lines"))


def neighbours(rows: DataFrame, n: int = 2) -> DataFrame:
    """For each pair the up to n pairs before it, cut to 40 characters a side, as numbered lines."""
    before = Window.partitionBy("conv_id").orderBy("idx").rowsBetween(-n, -1)
    one = F.struct(F.left("src", F.lit(40)).alias("s"), F.left("mt", F.lit(40)).alias("t"))
    l = rows.select("conv_id", "idx", F.filter(F.collect_list(one).over(before), lambda x: (x["s"] != "") & (x["t"] != "")).alias("l"))
    line = F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["s"], F.lit(" -> "), x["t"]))
    return l.select("conv_id", "idx", F.size("l").alias("n"), F.array_join(line, "\n").alias("anchor"))


def style_anchor(blocks: DataFrame, least: int = 900, most: int = 2200) -> DataFrame:
    """The opening of each document that shows its style: lines of 50 characters or more among the first five, until 900, at most 2200."""
    order = Window.partitionBy("doc_id").orderBy("block_idx")
    s = blocks.where("block_idx < 5").select("doc_id", "block_idx", X.strip(F.col("text")).alias("s")).where("length(s) >= 50")
    s = s.withColumn("before", F.coalesce(F.sum(F.length("s") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") - 2 < least)
    t = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "s"))).alias("l")).select("doc_id", F.array_join(F.col("l.s"), "\n\n").alias("t"))
    head = F.left("t", F.lit(most))
    stop = F.length(F.regexp_extract(head, r"(?s)^(.*[.?!])", 1))
    return t.select("doc_id", F.when(F.length("t") <= most, F.length("t")).when(stop - 1 > most * 0.55, stop).otherwise(most).alias("n_chars"), F.length("t").alias("found"))


QUERIES = {
    "chunk_blocks": lambda spark, d: chunked(V.table(spark, d, "documents")),
    "chunk_plan": lambda spark, d: planned(V.table(spark, d, "documents")),
    "chunk_texts": lambda spark, d: chunk_texts(V.blocks(spark, d)),
    "document_sections": lambda spark, d: sections(V.blocks(spark, d)),
    "carried_headings": lambda spark, d: carried_headings(V.blocks(spark, d)),
    "previous_examples": lambda spark, d: neighbours(V.pairs(spark, d)),
    "style_anchor": lambda spark, d: style_anchor(V.blocks(spark, d)),
}

_HEAD = r"(trim(text) <> '' and length(trim(text)) < 60 and (regexp_matches(trim(text), '^[0-9]+(\.[0-9]+)*\.?\s+[A-Z][\w\s\-:&,]+$') or regexp_matches(trim(text), '(?i)^(Abstract|Introduction|Background|Related Work|Methodology|Methods?|Approach|Experiments?|Experimental|Results?|Discussion|Conclusions?|References|Appendix|Acknowledgments?)\b') or starts_with(trim(text), '#')))"
_HEAD_X = _HEAD.replace("text", "x")
ORACLE_SQL = {
    "chunk_blocks": f"""with recursive b as (select doc_id, block_idx as i, length(text) as n from {V.SQL_BLOCKS}),
r as (select doc_id, i, 0 as chunk, n as size, n from b where i = 0
  union all select b.doc_id, b.i, case when r.size + b.n > 3500 then r.chunk + 1 else r.chunk end, case when r.size + b.n > 3500 then b.n else r.size + b.n end, b.n from r join b on b.doc_id = r.doc_id and b.i = r.i + 1)
select doc_id, i as block_idx, chunk, n as n_chars from r""",
    "chunk_plan": f"""with recursive b as (select doc_id, block_idx as i, length(x) as n, x = '' or regexp_matches(rtrim(x), '{STOP}') as stop, {_HEAD_X} as head from (select doc_id, block_idx, text as x from {V.SQL_BLOCKS})),
r as (select doc_id, i, 0 as chunk, n as size, n, stop from b where i = 0
  union all select b.doc_id, b.i, case when shut then r.chunk + 1 else r.chunk end, case when shut then b.n else r.size + b.n end, b.n, b.stop from (
    select r.*, (b.head and r.size > {SOFT} * 0.5) or r.size + b.n > {HARD} or (r.size + b.n > {SOFT} and r.stop) as shut from r join b on b.doc_id = r.doc_id and b.i = r.i + 1) r join b on b.doc_id = r.doc_id and b.i = r.i + 1)
select doc_id, chunk, min(i) as first, count(*) as blocks, sum(n) as n_chars from r group by 1, 2""",
    "style_anchor": f"""with s as (select doc_id, block_idx, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as s from {V.SQL_BLOCKS} where block_idx < 5),
k as (select *, coalesce(sum(length(s) + 2) over (partition by doc_id order by block_idx rows between unbounded preceding and 1 preceding), 0) as before from s where length(s) >= 50),
t as (select doc_id, string_agg(s, chr(10) || chr(10) order by block_idx) as t from k where before - 2 < 900 group by 1),
h as (select doc_id, t, length(regexp_extract(left(t, 2200), '(?s)^(.*[.?!])', 1)) as stop from t)
select doc_id, (case when length(t) <= 2200 then length(t) when stop - 1 > 2200 * 0.55 then stop else 2200 end)::int as n_chars, length(t)::int as found from h""",
    "chunk_texts": f"""select doc_id, block_idx // 10 as part, md5(string_agg('[' || block_idx || '] ' || array_to_string({X.sql_tokens("text")}, ' '), chr(10) || chr(10) order by block_idx)) as digest, count(*)::int as blocks from {V.SQL_BLOCKS} group by 1, 2""",
    "document_sections": f"""select doc_id, section, min(block_idx) as first, max(block_idx) as last, count(*) as blocks from (
  select *, sum({_HEAD}::int) over (partition by doc_id order by block_idx rows unbounded preceding) as section from {V.SQL_BLOCKS}) group by 1, 2""",
    "carried_headings": f"""select doc_id, coalesce(heading, '') as heading, count(*) as lines from (
  select doc_id, last_value(case when {_HEAD} then trim(text) end ignore nulls) over (partition by doc_id order by block_idx rows unbounded preceding) as heading from {V.SQL_BLOCKS}) group by 1, 2""",
    "previous_examples": f"""with p as (select conv_id, idx, row_number() over (partition by conv_id order by idx) as k, left(src, 40) as s, left(mt, 40) as t from {V.SQL_PAIRS}),
b as (select a.conv_id, a.idx, b.s, b.t, row_number() over (partition by a.conv_id, a.idx order by b.k) as i from p a join p b on b.conv_id = a.conv_id and b.k between a.k - 2 and a.k - 1 and b.s <> '' and b.t <> ''),
g as (select conv_id, idx, count(*) as n, string_agg(i || '. ' || s || ' -> ' || t, chr(10) order by i) as anchor from b group by 1, 2)
select conv_id, idx, coalesce(n, 0) as n, coalesce(anchor, '') as anchor from p left join g using (conv_id, idx)""",
}
