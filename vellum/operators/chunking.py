"""Chunks of documents: heading first, at section titles, and of LaTeX blocks.

Packing is one rule with other numbers: it goes over a document's pieces in order and
carries no more than the size of the open chunk.  Where pieces are rows, numbers alone go
through it, partitioned by document and ordered by piece, so no document becomes one array;
a section of Markdown, which is one row, is packed in its row by the lengths of its paragraphs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import SPACE, bound, strip
from vellum.operators import latex, segments
from vellum.sources import views as V

# A heading of Markdown, paragraphs' ends, and the characters of a chunk.
HEADING, PARAGRAPH, MOST = rf"(?dm)^#{{1,6}}[{SPACE}]+.+$", r"\n\n+", 1500
# Target and limit of a planned chunk, the share of the target from which a section title closes one, characters of a block that a title is known by, and of a LaTeX chunk.
TARGET, LIMIT, TITLE_SHARE, KNOWN_BY, LATEX_TARGET = 1500, 2200, 0.5, 30, 1500
NEVER = 1 << 40


_PACKED = "doc_id bigint, part bigint, piece bigint, chunk int"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunk of each piece (doc_id, part, piece, n, solid, title, ends, soft, title_from, hard), in order.

    A chunk with a solid piece closes before a title once it is over title_from long,
    before a piece that takes it over ``hard``, or over ``soft`` after a piece that ends a
    sentence.
    """
    now, chunk, size, filled, ended = None, 0, 0, False, False
    for batch in batches:
        out = []
        doc_id, part, _, *rest = (c.to_pylist() for c in batch.columns)
        for at, (n, solid, title, ends, soft, title_from, hard) in zip(zip(doc_id, part, strict=True), zip(*rest, strict=True), strict=True):
            if at != now:
                now, chunk, size, filled, ended = at, 0, 0, False, False
            if filled and ((title and size > title_from) or size + n > hard or (size + n > soft and ended)):
                chunk, size, filled = chunk + 1, 0, False
            size += n
            filled, ended = filled or solid, ends
            out.append(chunk)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int32())], ["doc_id", "part", "piece", "chunk"])


def packed(pieces: DataFrame, n: Column, hard: int, solid: Column | None = None, title: Column | None = None, ends: Column | None = None, soft: int = NEVER, title_from: float = 0.0) -> DataFrame:
    """``pieces`` (doc_id, part, piece, ...) with ``chunk``, from 0 in each part; ids and numbers are whole numbers, none null."""
    true, false = F.lit(True), F.lit(False)
    rows = pieces.select(
        F.col("doc_id").cast("bigint"), F.col("part").cast("bigint"), F.col("piece").cast("bigint"), n.cast("bigint").alias("n"), (true if solid is None else solid).alias("solid"),
        (false if title is None else title).alias("title"), (false if ends is None else ends).alias("ends"), F.lit(soft).cast("bigint").alias("soft"), F.lit(float(title_from)).alias("title_from"), F.lit(hard).cast("bigint").alias("hard"),
    )
    got = rows.repartition("doc_id", "part").sortWithinPartitions("doc_id", "part", "piece").mapInArrow(_pack, _PACKED)
    return pieces.join(got, ["doc_id", "part", "piece"])


# ---- Markdown ---------------------------------------------------------------------


def markdown_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section, heading, body): the text (doc_id, text) up to the first heading, then under each.

    A section without text stays if it has a heading and isn't the last.
    """
    text = F.coalesce("text", F.lit(""))
    found = F.struct(F.regexp_extract_all(text, F.lit(HEADING), F.lit(0)).alias("headings"), F.split(text, HEADING).alias("bodies"))

    def sections(t: Column) -> Column:
        return F.transform(t["bodies"], lambda b, i: F.struct(F.when(i == 0, "").otherwise(F.get(t["headings"], i - 1)).alias("heading"), b.alias("body"), (i == F.size(t["headings"])).alias("last")))

    each = bound(found, sections)
    rows = docs.select("doc_id", F.posexplode(each).alias("section", "s")).select("doc_id", "section", "s.*")
    return rows.where((strip(F.col("body")) != "") | ((F.col("heading") != "") & ~F.col("last"))).drop("last")


def markdown_chunks(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, section, chunk, heading, text): sections with text; one of over ``most`` characters is packed by paragraphs."""
    rows = markdown_sections(docs).select("doc_id", "section", "heading", strip(F.col("body")).alias("body")).where("body <> ''")
    pieces = F.when(F.length("body") <= most, F.array("body")).otherwise(F.filter(F.split("body", PARAGRAPH), lambda p: strip(p) != ""))
    each = rows.select("doc_id", "section", "heading", pieces.alias("pieces"))
    # a row's text stays where it is: its lengths go to Python, the first piece of each chunk comes back
    each = each.withColumn("c", segments.pack_column(most)(F.transform("pieces", lambda p: F.length(p) + 2)))
    starts = lambda c: F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: (i == 0) | (F.get(c, i) != F.get(c, i - 1)))
    each = each.withColumn("starts", starts(F.col("c"))).select("doc_id", "section", "heading", "pieces", "starts", F.posexplode("starts").alias("chunk", "start"))
    end = F.coalesce(F.get("starts", F.col("chunk") + 1), F.size("pieces"))
    text = strip(F.array_join(F.slice("pieces", F.col("start") + 1, end - F.col("start")), "\n\n"))
    return each.select("doc_id", "section", "chunk", "heading", text.alias("text"))


# ---- section titles -----------------------------------------------------------------


def planned_chunks(blocks: DataFrame, titles: DataFrame, target: int = TARGET, limit: int = LIMIT) -> DataFrame:
    """``blocks`` (doc_id, piece, text) with ``chunk``.

    ``titles`` (doc_id, title) are the sections'.  In a document of two sections or more a
    block is a title if the first 30 characters of its text begin one, letter case aside.
    """
    many = titles.groupBy("doc_id").agg(F.count("*").alias("n")).where("n >= 2").select("doc_id")
    heads = F.explode(F.transform(F.sequence(F.lit(0), F.least(F.length("title"), F.lit(KNOWN_BY))), lambda k: F.left(F.lower("title"), k)))
    known = titles.join(many, "doc_id", "left_semi").select("doc_id", heads.alias("head")).distinct().withColumn("is_title", F.lit(True))
    rows = blocks.withColumn("part", F.lit(0).cast("bigint")).withColumn("head", F.lower(F.left(strip(F.col("text")), F.lit(KNOWN_BY)))).join(known, ["doc_id", "head"], "left").drop("head")
    is_title = F.coalesce("is_title", F.lit(False)) & (F.coalesce("text", F.lit("")) != "")
    ends = F.coalesce(F.rtrim("text").rlike(segments.STOP), F.lit(False)) | (F.coalesce("text", F.lit("")) == "")
    return packed(rows, F.length(F.coalesce("text", F.lit(""))), limit, title=is_title, ends=ends, soft=target, title_from=target * TITLE_SHARE).drop("part", "is_title")


# ---- LaTeX --------------------------------------------------------------------------


def latex_chunks(docs: DataFrame, target: int = LATEX_TARGET) -> DataFrame:
    """(doc_id, chunk, text): the text up to the start of the document, then its blocks packed; without any, the text itself.

    White space alone fills no chunk, and none is left of it at the end.
    """
    text = F.coalesce("text", F.lit(""))
    begin = F.locate(r"\begin{document}", text)
    cut = F.when(begin > 0, begin + len(r"\begin{document}") - 1).otherwise(0)
    split = docs.select("doc_id", text.alias("text"), F.left(text, cut).alias("preamble"), F.substring(text, cut + 1, F.lit(1 << 30)).alias("body"))
    pieces = split.select("doc_id", F.lit(0).alias("part"), F.posexplode(latex.blocks_column("body")).alias("piece", "text"))
    got = packed(pieces, F.length("text"), target, solid=strip(F.col("text")) != "")
    rows = got.groupBy("doc_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda p: p["text"]), "").alias("text")).where(strip(F.col("text")) != "")
    first = split.where("preamble <> ''").select("doc_id", F.lit(-1).alias("chunk"), F.col("preamble").alias("text"))
    found = first.unionByName(rows)
    rest = split.join(found, "doc_id", "left_anti").select("doc_id", F.lit(0).alias("chunk"), "text")
    return found.join(first.select("doc_id", F.lit(1).alias("more")), "doc_id", "left").select("doc_id", (F.col("chunk") + F.coalesce("more", F.lit(0))).alias("chunk"), "text").unionByName(rest)


# ---- documents in these forms ---------------------------------------------------------


def _markdown(spark, d) -> DataFrame:
    """Documents as Markdown: every sixth line is a heading of at most 40 characters, lines are paragraphs."""
    line = lambda x, i: F.when(i % 6 == 0, F.concat(F.lit("## "), F.left(x, F.lit(40)))).otherwise(x)
    return V.table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n\n").alias("text"))


def _markdown_chunks(spark, d) -> DataFrame:
    out = markdown_chunks(_markdown(spark, d))
    return out.select("doc_id", "section", "chunk", "heading", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def _planned(spark, d) -> DataFrame:
    """Lines of documents as blocks; every tenth line that isn't blank is the title of a section, as its first 50 characters."""
    blocks = V.blocks(spark, d).withColumnRenamed("block_idx", "piece")
    titles = blocks.where((F.col("piece") % 10 == 0) & (F.trim("text") != "")).select("doc_id", F.left(F.trim("text"), F.lit(50)).alias("title"))
    return planned_chunks(blocks, titles).groupBy("doc_id", "chunk").agg(F.min("piece").alias("first"), F.count("*").alias("blocks"), F.sum(F.length("text")).alias("n_chars"))


def _latex_chunks(spark, d) -> DataFrame:
    """Documents as LaTeX: every eighth line opens an environment that closes four lines on, every eleventh is a section."""
    line = lambda x, i: F.when(i % 8 == 2, F.concat(F.lit("\\begin{q}"), x)).when(i % 8 == 6, F.concat(x, F.lit("\\end{q}"))).when(i % 11 == 0, F.concat(F.lit("\\section{"), F.left(x, F.lit(20)), F.lit("}"))).otherwise(F.concat(x, F.lit("\n")))
    t = V.table(spark, d, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 3 > 0, "\\documentclass{a}\n\\begin{document}\n").otherwise(""), F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n")).alias("text"))
    return latex_chunks(t).select("doc_id", "chunk", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


QUERIES = {"markdown_chunks": _markdown_chunks, "planned_chunks": _planned, "latex_chunks": _latex_chunks}

ORACLE_SQL = {
    "markdown_chunks": f"""with recursive l as (select doc_id, generate_subscripts(ws, 1) - 1 as i, unnest(ws) as x from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ws from documents)),
h as (select doc_id, i, i % 6 = 0 and trim(left(x, 40)) <> '' as head, case when i % 6 = 0 then '## ' || left(x, 40) else x end as x from l),
s as (select *, sum(head::int) over (partition by doc_id order by i) as section from h),
b as (select doc_id, section, coalesce(max(x) filter (head), '') as heading, trim(string_agg(x, chr(10) || chr(10) order by i) filter (not head), ' ' || chr(9) || chr(10) || chr(13)) as body from s group by 1, 2),
p as (select doc_id, section, heading, row_number() over (partition by doc_id, section order by k) as k, text from (
  select doc_id, section, heading, generate_subscripts(ps, 1) as k, unnest(ps) as text from (select *, regexp_split_to_array(body, '\n\n+') as ps from b where length(body) > {MOST})) where trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
r as (select doc_id, section, k, 0 as chunk, length(text) + 2 as size from p where k = 1
  union all select p.doc_id, p.section, p.k, case when size + length(text) + 2 > {MOST} then chunk + 1 else chunk end, case when size + length(text) + 2 > {MOST} then length(text) + 2 else size + length(text) + 2 end
  from r join p on p.doc_id = r.doc_id and p.section = r.section and p.k = r.k + 1),
c as (select p.doc_id, p.section, chunk, heading, trim(string_agg(text, chr(10) || chr(10) order by p.k), ' ' || chr(9) || chr(10) || chr(13)) as text from p join r using (doc_id, section, k) group by all
  union all select doc_id, section, 0, heading, body from b where body <> '' and length(body) <= {MOST})
select doc_id, section::int as section, chunk, heading, length(text)::int as n_chars, md5(text) as digest from c""",
    "planned_chunks": f"""with recursive b as (select doc_id, block_idx as piece, text from {V.SQL_BLOCKS}),
t as (select doc_id, lower(left(trim(text), 50)) as title from b where piece % 10 = 0 and trim(text) <> ''), m as (select doc_id from t group by 1 having count(*) >= 2),
e as (select doc_id, piece, length(text) as n, text <> '' and doc_id in (select doc_id from m) and exists (select 1 from t where t.doc_id = b.doc_id and starts_with(t.title, lower(left(trim(b.text), {KNOWN_BY})))) as title,
  text = '' or regexp_matches(rtrim(text), '[.!?;:]\\s*[")]?$') as ends from b),
r as (select doc_id, piece, 0 as chunk, n as size, ends from e where piece = 0
  union all select e.doc_id, e.piece, case when shut then chunk + 1 else chunk end, case when shut then e.n else size + e.n end, e.ends from (
    select r.*, (e.title and size > {TARGET * TITLE_SHARE}) or size + e.n > {LIMIT} or (size + e.n > {TARGET} and r.ends) as shut from r join e on e.doc_id = r.doc_id and e.piece = r.piece + 1) r
  join e on e.doc_id = r.doc_id and e.piece = r.piece + 1)
select r.doc_id, chunk, min(r.piece) as first, count(*) as blocks, sum(e.n) as n_chars from r join e on e.doc_id = r.doc_id and e.piece = r.piece group by all""",
}
