"""Titles of pages, headings translated from a dictionary, and terms as a document yields them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions.text import strip
from vellum.operators import geometry
from vellum.plans import responses
from vellum.sources import views as V

# Titles that say nothing, and of a title's blocks the least size in points, the share of the largest size, of the page's height, and its length.
NO_TITLE = ("untitled", "microsoft word")
LEAST_SIZE, SIZE_SHARE, UPPER, TITLE_LENGTH, LEAST_CHARS = 10, 0.85, 0.55, 200, 5
# Headings with their translations.
HEADINGS = {
    "abstract": "Tóm tắt", "introduction": "Giới thiệu", "related work": "Công trình liên quan", "related works": "Công trình liên quan",
    "background": "Nền tảng", "preliminaries": "Kiến thức nền", "method": "Phương pháp", "methods": "Phương pháp",
    "methodology": "Phương pháp nghiên cứu", "approach": "Phương pháp tiếp cận", "model": "Mô hình", "models": "Mô hình",
    "architecture": "Kiến trúc", "experiment": "Thực nghiệm", "experiments": "Thực nghiệm", "experimental setup": "Thiết lập thực nghiệm",
    "experimental results": "Kết quả thực nghiệm", "results": "Kết quả", "result": "Kết quả", "evaluation": "Đánh giá",
    "discussion": "Thảo luận", "analysis": "Phân tích", "ablation": "Nghiên cứu ablation", "ablation study": "Nghiên cứu ablation",
    "conclusion": "Kết luận", "conclusions": "Kết luận", "future work": "Hướng nghiên cứu tương lai", "limitations": "Hạn chế",
    "acknowledgment": "Lời cảm ơn", "acknowledgments": "Lời cảm ơn", "acknowledgement": "Lời cảm ơn", "acknowledgements": "Lời cảm ơn",
    "references": "Tài liệu tham khảo", "appendix": "Phụ lục", "supplementary": "Tài liệu bổ sung", "overview": "Tổng quan",
    "framework": "Khung làm việc", "training": "Huấn luyện", "inference": "Suy luận", "dataset": "Bộ dữ liệu", "datasets": "Bộ dữ liệu",
    "baseline": "Phương pháp cơ sở", "baselines": "Phương pháp cơ sở", "comparison": "So sánh", "notation": "Ký hiệu",
    "problem formulation": "Phát biểu bài toán", "problem statement": "Phát biểu bài toán", "task definition": "Định nghĩa bài toán",
    "implementation details": "Chi tiết cài đặt", "implementation": "Cài đặt", "setup": "Thiết lập", "main results": "Kết quả chính", "summary": "Tổng kết",
}
# Commands that hold a heading, and what is no text in LaTeX.
HEADING = r"^\\(section|subsection|subsubsection|paragraph|subparagraph|chapter|part|caption|captionof|footnote|title|author|date|thanks|textbf|textit|emph)\*?\{([^}]*)\}[\s%]*$"
NO_TEXT = (("%.*", ""), (r"\\begin\{[^}]*\}|\\end\{[^}]*\}", " "), (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])*(?:\{[^}]*\})*", " "), (r"[${}()\[\]\\]", " "), (r"\s+", " "))
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
TEXT_LENGTH = 10
# Chunks between looks for terms, and the least length of one looked at.
EVERY, LONG = 5, 300


def page_info(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page_count, has_text, total_chars, title) of documents out of their pages and the text blocks of the first.

    ``pages`` has doc_id, page_num from 0, text, height and meta_title; ``blocks`` doc_id,
    block_idx, y0, size (the largest of its spans) and text.  The title that the document
    names counts if it has over five characters and says something.  Else all blocks
    in the upper part of the first page whose size comes near the largest one's, from the top,
    if that is over 10 points.  At most 200 characters; empty without any.
    """
    text = strip(F.coalesce("text", F.lit("")))
    told = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.bool_or(text != "").alias("has_text"), F.sum(F.length(text)).alias("total_chars"), F.max(F.when(F.col("page_num") == 0, F.struct("height", "meta_title"))).alias("first"))
    seen = blocks.withColumn("text", strip(F.coalesce("text", F.lit("")))).where((F.col("size") > 0) & (F.length("text") > LEAST_CHARS))
    largest = seen.groupBy("doc_id").agg(F.max("size").alias("largest"))
    near = seen.join(largest, "doc_id").join(told.select("doc_id", F.col("first.height").alias("height")), "doc_id")
    near = near.where((F.col("largest") > LEAST_SIZE) & (F.col("size") >= F.col("largest") * SIZE_SHARE) & (F.col("y0") < F.col("height") * UPPER))
    lines = near.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "block_idx", "text"))), lambda b: b["text"]), " ").alias("joined"))
    meta = strip(F.coalesce("first.meta_title", F.lit("")))
    good = (F.length(meta) > LEAST_CHARS) & ~F.lower(meta).isin(*NO_TITLE)
    title = F.left(F.when(good, meta).otherwise(F.coalesce("joined", F.lit(""))), F.lit(TITLE_LENGTH))
    return told.join(lines, "doc_id", "left").select("doc_id", "page_count", "has_text", "total_chars", title.alias("title"))


def inline(chunk: Column) -> Column:
    """(how, text) of a LaTeX chunk that needs no model; both null for one that does, and for null.

    how is ``same`` where next to no text is left without its commands, and
    ``dictionary`` where every line that isn't blank or a comment is a command with a
    heading: known ones are replaced, others stay; blank lines and comments go.
    """
    blank = lambda x: (strip(x) == "") | strip(x).startswith("%")
    lines = F.filter(F.split(strip(chunk), LINE_END), lambda x: ~blank(x))
    plain = chunk
    for pattern, by in NO_TEXT:
        plain = F.regexp_replace(plain, pattern, by)
    known = F.create_map(*(F.lit(x) for pair in HEADINGS.items() for x in pair))
    said = lambda x: strip(F.regexp_extract(strip(x), HEADING, 2))
    vi = lambda x: F.try_element_at(known, F.lower(said(x)))
    out = F.array_join(F.transform(lines, lambda x: F.when(vi(x).isNotNull(), F.replace(x, said(x), vi(x))).otherwise(x)), "\n")
    told = lambda how, text: F.struct(F.lit(how).alias("how"), text.alias("text"))
    none = F.lit(None).cast("string")
    return (
        F.when(chunk.isNull(), F.struct(none.alias("how"), none.alias("text")))
        .when((F.size(lines) == 0) | (F.length(strip(plain)) < TEXT_LENGTH), told("same", chunk))
        .when(F.forall(lines, lambda x: strip(x).rlike(HEADING)), told("dictionary", out))
        .otherwise(F.struct(none.alias("how"), none.alias("text")))
    )


def rolling_terms(chunks: DataFrame, answers: DataFrame, seed: DataFrame, document: DataFrame, every: int = EVERY, least: int = LONG) -> DataFrame:
    """(doc_id, idx, en, vi, known): the terms that each chunk adds to its document's glossary, and how many discovered ones the document has then.

    ``chunks`` (doc_id, idx, src); every fifth of a document is looked at if it is long
    enough.  ``answers`` (doc_id, idx, raw) are what a model says of them.  A term counts
    where it comes first, and only if neither ``seed`` (en) nor the ``document``'s own
    layer (doc_id, en) has it; said twice in one answer, the last translation holds.
    """
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))
    looked = chunks.withColumn("n", n).where((F.col("n") % every == 0) & (F.length("src") >= least)).select("doc_id", "idx")
    said = answers.join(looked, ["doc_id", "idx"], "left_semi").select("doc_id", "idx", F.posexplode(responses.strict_term_lines(F.col("raw"))).alias("pos", "t"))
    said = said.groupBy("doc_id", "idx", F.col("t.en").alias("en")).agg(F.max_by("t.vi", "pos").alias("vi"))
    first = said.groupBy("doc_id", "en").agg(F.min(F.struct("idx", "vi")).alias("at")).select("doc_id", "at.idx", "en", "at.vi")
    new = first.join(seed.select("en").distinct(), "en", "left_anti").join(document.select("doc_id", "en").distinct(), ["doc_id", "en"], "left_anti")
    by_chunk = Window.partitionBy("doc_id").orderBy("idx").rangeBetween(Window.unboundedPreceding, 0)
    return new.select("doc_id", "idx", "en", "vi", F.count("*").over(by_chunk).alias("known"))


# ---- tables in these forms --------------------------------------------------------------


def _info(spark, d) -> DataFrame:
    """Orders as documents whose line items are the blocks of the first page; sizes, texts and named titles by rule."""
    b = geometry.boxes(spark, d)
    k = F.col("page_num")
    blocks = b.select(k.alias("doc_id"), "block_idx", "y0", (6 + (F.col("x0") / 20 + F.col("block_idx")) % 9).alias("size"), F.concat(F.lit(" title "), F.col("block_idx"), F.when(F.col("block_idx") % 2 == 0, F.repeat(F.lit("x"), (k % 90).cast("int"))).otherwise("")).alias("text"))
    pages = b.groupBy(k.alias("doc_id"), (F.col("block_idx") % 3).cast("int").alias("page_num")).agg(F.max("y1").alias("height"))
    meta = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Named "), F.col("doc_id"))).when(F.col("doc_id") % 5 == 1, "Untitled").when(F.col("doc_id") % 5 == 2, "short")
    pages = pages.select("doc_id", "page_num", F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("p "), "page_num")).alias("text"), F.lit(842.0).alias("height"), meta.alias("meta_title"))
    return page_info(pages, blocks)


def _inline(spark, d) -> DataFrame:
    """Lines of documents as LaTeX chunks of five kinds by their number."""
    t = V.blocks(spark, d)
    i = F.col("block_idx")
    heading = F.element_at(F.array(*map(F.lit, HEADINGS)), (i % len(HEADINGS) + 1).cast("int"))
    some = F.left(F.regexp_replace("text", r"[{}%\\]", ""), F.lit(30))
    chunk = (
        F.when(i % 5 == 0, F.concat(F.lit("\\section{"), F.initcap(heading), F.lit("}\n% note\n\n\\textbf{"), some, F.lit("}")))
        .when(i % 5 == 1, F.concat(F.lit("\\begin{equation}$x$\\end{equation}\n"), F.left(some, F.lit(6))))
        .when(i % 5 == 2, F.concat(F.lit("\\subsection*{"), heading, F.lit("} %\n"), "text"))
        .when(i % 5 == 3, F.col("text"))
        .otherwise(F.concat(F.lit("% only\n"), F.lit("  ")))
    )
    out = t.select("doc_id", "block_idx", inline(chunk).alias("r"))
    return out.select("doc_id", "block_idx", "r.how", F.md5(F.col("r.text").cast("binary")).alias("digest"))


def _terms(spark, d) -> DataFrame:
    """Single lines as chunks; the answer names each word of nine small letters or more, with its reverse; the first line's words are the document's own layer."""
    lines = V.blocks(spark, d).select("doc_id", F.col("block_idx").alias("idx"), F.col("text").alias("src"))
    words = F.array_distinct(F.regexp_extract_all("src", F.lit("[a-z]{9,}"), F.lit(0)))
    answers = lines.select("doc_id", "idx", F.array_join(F.transform(words, lambda w: F.concat(w, F.lit(" → "), F.reverse(w))), "\n").alias("raw"))
    own = lines.where("idx = 0").select("doc_id", F.explode(words).alias("en"))
    return rolling_terms(lines, answers, V.terms(spark, d), own)


QUERIES = {"page_titles": _info, "inline_headings": _inline, "rolling_terms": _terms}

_MAP = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in HEADINGS.items()) + "}"
_SQL_HEADING = HEADING
ORACLE_SQL = {
    "page_titles": f"""with {geometry._B}, bl as (select page_num as doc_id, block_idx, y0, 6 + (x0 / 20 + block_idx) % 9 as size, trim(' title ' || block_idx || case when block_idx % 2 = 0 then repeat('x', (page_num % 90)::int) else '' end) as text from b),
p as (select distinct page_num as doc_id, block_idx % 3 as page_num from b),
i as (select doc_id, count(*) as page_count, doc_id % 4 > 0 as has_text, sum(case when doc_id % 4 > 0 then 3 else 0 end) as total_chars, bool_or(page_num = 0) as has_first from p group by 1),
s as (select doc_id, max(size) as largest from bl where length(text) > 5 group by 1),
t as (select doc_id, string_agg(text, ' ' order by y0, block_idx) as joined from bl join s using (doc_id) join i using (doc_id) where has_first and length(text) > 5 and largest > 10 and size >= largest * 0.85 and y0 < 842 * 0.55 group by 1)
select doc_id, page_count, has_text, total_chars, left(case when has_first and doc_id % 5 = 0 then 'Named ' || doc_id else coalesce(joined, '') end, 200) as title from i left join t using (doc_id)""",
    "inline_headings": rf"""with h as (select {list(HEADINGS)} as hs), b as (select doc_id, block_idx, text, hs[block_idx % {len(HEADINGS)} + 1] as heading, left(regexp_replace(text, '[{{}}%\\]', '', 'g'), 30) as few from {V.SQL_BLOCKS}, h),
c as (select doc_id, block_idx, case block_idx % 5
    when 0 then '\section{{' || array_to_string(list_transform(string_split(heading, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || '}}' || chr(10) || '% note' || chr(10) || chr(10) || '\textbf{{' || few || '}}'
    when 1 then '\begin{{equation}}$x$\end{{equation}}' || chr(10) || left(few, 6)
    when 2 then '\subsection*{{' || heading || '}} %' || chr(10) || text when 3 then text else '% only' || chr(10) || '  ' end as chunk from b),
l as (select *, list_filter(string_split(trim(chunk, ' ' || chr(9) || chr(10) || chr(13)), chr(10)), lambda x: trim(x) <> '' and not starts_with(trim(x), '%')) as lines,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(chunk, '%[^\n]*', '', 'g'), '\\begin\{{[^}}]*\}}|\\end\{{[^}}]*\}}', ' ', 'g'), '\\[a-zA-Z]+\*?(?:\[[^\]]*\])*(?:\{{[^}}]*\}})*', ' ', 'g'), '[${{}}()\[\]\\]', ' ', 'g'), '\s+', ' ', 'g')) as plain from c),
r as (select *, case when len(lines) = 0 or length(plain) < 10 then 'same' when len(list_filter(lines, lambda x: not regexp_matches(trim(x), '{_SQL_HEADING}'))) = 0 then 'dictionary' end as how from l),
o as (select doc_id, block_idx, how, case how when 'same' then chunk when 'dictionary' then array_to_string(list_transform(lines, lambda x: coalesce(
  replace(x, trim(regexp_extract(trim(x), '{_SQL_HEADING}', 2)), ({_MAP})[lower(trim(regexp_extract(trim(x), '{_SQL_HEADING}', 2)))]), x)), chr(10)) end as text from r)
select doc_id, block_idx, how, md5(text) as digest from o""",
    "rolling_terms": f"""with b as (select doc_id, block_idx as idx, text as src, list_distinct(regexp_extract_all(text, '[a-z]{{9,}}')) as ws from {V.SQL_BLOCKS}),
w as (select doc_id, idx, unnest(ws) as en from b where (idx + 1) % {EVERY} = 0 and length(src) >= {LONG}),
f as (select doc_id, en, min(idx) as idx from w group by 1, 2),
n as (select * from f where en not in (select en from {V.SQL_TERMS}) and (doc_id, en) not in (select doc_id, unnest(ws) from b where idx = 0))
select doc_id, idx, en, reverse(en) as vi, count(*) over (partition by doc_id order by idx) as known from n""",
}
