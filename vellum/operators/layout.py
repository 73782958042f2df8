"""Geometry and style of page blocks: predicates on columns, and rectangles that meet blocks.

A block row has page_num, block_idx, text, x0, y0, x1, y1 and ``spans``, an array of
(text, font, size, flags, y).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions.text import strip
from vellum.operators import tables

# Ranges of mathematical characters, fonts of mathematics, and the bits and names that fonts use for styles.
MATH_CHARS = r"[\x{0370}-\x{03ff}\x{2070}-\x{209f}\x{2100}-\x{214f}\x{2150}-\x{218f}\x{2190}-\x{21ff}\x{2200}-\x{22ff}\x{2300}-\x{23ff}\x{27c0}-\x{27ef}\x{2980}-\x{29ff}\x{2a00}-\x{2aff}\x{1d400}-\x{1d7ff}]"
MATH_FONT = (
    r"(?i)(CMM[A-Z]|CMSY|CMEX|MSAM|MSBM|Symbol|Math|rsfs|eufm|stmary|wasy|lasy|esint|bbold|dsrom|EUSM|EURM|cmmi|LMSym|STIX|XITS|Neo\s*Euler"
    r"|txsy|txex|pxsy|pxex|boondox|dutchcal)"
)
ITALIC_BIT, BOLD_BIT, RAISED_BIT = 2, 16, 1
BOLD_NAME, ITALIC_NAME = r"(?i)(Bold|Medi|CMBX|CMBXTI|Demi|Heavy|Black|-Bd|-B$|bd$)", r"(?i)(Italic|Ital|Oblique|CMTI|CMBXTI|Slant|-It|-I$|it$)"
# Points off the line and share of its size from which a span stands out, signs of operations, short names, and the size of a line without text.
OFF_LINE, SMALLER, OPERATORS, SHORT_NAME, NO_SIZE = 1.5, 0.85, r"[+\-=<>≤≥≠≈∞∑∏∫∂∇±×÷^_]", "^[A-Za-z][A-Za-z0-9]{0,3}$", 10.0
# Width of a block that tells columns, as a share of the page, and how far from its middle they part.
BODY_WIDTH, MIDDLE = 0.25, 20
# A box is narrow under the first width, or under the second if it is so many times as high as wide.
NARROW, SLIM, TALL = 25, 40, 2.5
# Labels of captions with their number and mark.
CAPTION = r"^\s*(?iu)(Figure|Fig\.?|Table|Hình|Bảng|Biểu\s*đồ)\s*\d+\s*[.:—–\-]"
# Width of a glyph and height of a line against the font size; of each role of a block, what its box is enlarged by, its least share of the source and the share without a box.
GLYPH_WIDTH, LINE_HEIGHT = 0.5, 1.35
BUDGETS = {"plain": (1.15, 1.1, 1.4), "table": (1.05, 1.0, 1.15), "caption": (1.08, 1.05, 1.2)}


def is_math_char(ch: Column) -> Column:
    return ch.rlike(f"^{MATH_CHARS}$")


def math_share(text: Column) -> Column:
    """Mathematical characters against all, white space at the ends aside; 0 without any."""
    bare = strip(text)
    return F.when(bare == "", 0.0).otherwise(F.regexp_count(bare, F.lit(MATH_CHARS)) / F.length(bare))


def is_math_span(span: Column) -> Column:
    """By font, by the superscript bit, or by more than half mathematical characters."""
    return F.coalesce(span["font"].rlike(MATH_FONT), F.lit(False)) | (F.coalesce(span["flags"], F.lit(0)).bitwiseAND(F.lit(RAISED_BIT)) != 0) | (math_share(span["text"]) > 0.5)


def is_geometric_math(span: Column, base_y: Column, base_size: Column) -> Column:
    """A span off the line, or small, that holds a mathematical character or a sign of operation; off the line a short name counts too. Footnote numbers don't."""
    text = strip(span["text"])
    off = F.abs(base_y - span["y"]) > OFF_LINE
    small = F.coalesce(F.nullif(span["size"], F.lit(0.0)), base_size) < base_size * SMALLER
    told = text.rlike(MATH_CHARS) | text.rlike(OPERATORS) | (off & text.rlike(SHORT_NAME))
    return (text != "") & (off | small) & told


def span_style(span: Column) -> Column:
    has = lambda bit, name: (F.coalesce(span["flags"], F.lit(0)).bitwiseAND(F.lit(bit)) != 0) | F.coalesce(span["font"].rlike(name), F.lit(False))
    return F.struct(has(BOLD_BIT, BOLD_NAME).alias("bold"), has(ITALIC_BIT, ITALIC_NAME).alias("italic"))


def _weight(spans: Column, test) -> Column:
    """The share of characters, white space at the ends of spans aside."""
    total = F.aggregate(spans, F.lit(0), lambda a, s: a + F.length(strip(s["text"])))
    part = F.aggregate(spans, F.lit(0), lambda a, s: a + F.when(test(s), F.length(strip(s["text"]))).otherwise(0))
    return F.when(F.coalesce(total, F.lit(0)) == 0, 0.0).otherwise(part / total)


def block_style(spans: Column) -> Column:
    """Bold and italic by the majority of characters."""
    return F.struct((_weight(spans, lambda s: span_style(s)["bold"]) > 0.5).alias("bold"), (_weight(spans, lambda s: span_style(s)["italic"]) > 0.5).alias("italic"))


def is_bold_block(spans: Column) -> Column:
    """At least six tenths of the characters, white space too, in spans that are bold by bit or by the word in the font's name."""
    bold = lambda s: (F.coalesce(s["flags"], F.lit(0)).bitwiseAND(F.lit(BOLD_BIT)) != 0) | F.coalesce(s["font"].rlike("Bold|bold"), F.lit(False))
    n = lambda test: F.aggregate(spans, F.lit(0), lambda a, s: a + F.when(test(s), F.length(s["text"])).otherwise(0))
    return F.coalesce(n(bold) >= 0.6 * n(lambda s: F.lit(True)), F.lit(False)) & F.coalesce(n(lambda s: F.lit(True)) > 0, F.lit(False))


def baseline(spans: Column, bottom: Column | None = None) -> Column:
    """Mean height and size of a line, weighted by characters; without any its ``bottom``, and 10 points."""
    n = F.aggregate(spans, F.lit(0.0), lambda a, s: a + F.length(strip(s["text"])))
    mean = lambda f, none: F.when(n > 0, F.aggregate(spans, F.lit(0.0), lambda a, s: a + F.length(strip(s["text"])) * s[f]) / n).otherwise(none)
    return F.struct(mean("y", F.lit(None).cast("double") if bottom is None else bottom).alias("y"), mean("size", F.lit(NO_SIZE)).alias("size"))


def is_header_footer(y0: Column, y1: Column, height: Column) -> Column:
    """Begins in the top six hundredths of the page or ends in the bottom ones."""
    return (y0 < height * 0.06) | (y1 > height * 0.94)


def caption_kind(text: Column) -> Column:
    """table or figure where the text opens with a label, a number and a mark; else null."""
    label = F.lower(F.regexp_extract(text, CAPTION, 1))
    return F.when(label.isin("table", "bảng"), "table").when(label != "", "figure")


def capacity(x0: Column, y0: Column, x1: Column, y1: Column, size: Column) -> Column:
    """Characters that fit a box: columns of half the font size times lines of 1.35 of it, cut to a whole number; 0 without an area."""
    fs = F.greatest(size, F.lit(4.0))
    return (F.greatest(x1 - x0, F.lit(0.0)) / (fs * GLYPH_WIDTH) * (F.greatest(y1 - y0, F.lit(0.0)) / (fs * LINE_HEIGHT))).cast("int")


def block_budget(fits: Column, n_chars: Column, kind: Column) -> Column:
    """Characters that a translation of a block should have at most.

    What fits the box, enlarged, but no less than a share of the source; of the source
    alone without a box. ``kind`` is table, caption or anything else.
    """

    def tier(name: str) -> Column:
        inflate, floor, fallback = BUDGETS[name]
        unboxed = (n_chars * fallback).cast("int")
        return F.when(fits == 0, F.when(unboxed == 0, 100).otherwise(unboxed)).otherwise(F.greatest((fits * inflate).cast("int"), (n_chars * floor).cast("int")))

    return F.when(kind == "table", tier("table")).when(kind == "caption", tier("caption")).otherwise(tier("plain"))


def budgeted_text(blocks: DataFrame) -> DataFrame:
    """(chunk, text, n_blocks): each chunk's blocks (chunk, block_idx, text, kind, budget), numbered, with their budgets."""
    order = Window.partitionBy("chunk").orderBy("block_idx")
    role = F.when(F.col("kind") == "table", "table cell, ").when(F.col("kind") == "caption", "caption, ").otherwise("")
    line = F.format_string("[%d] (%smax ~%d chars) %s", F.row_number().over(order), role, F.col("budget"), F.col("text"))
    lines = blocks.select("chunk", "block_idx", line.alias("line"))
    return lines.groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "line"))), lambda x: x["line"]), "\n\n").alias("text"), F.count("*").alias("n_blocks"))


def is_narrow_vertical(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Too narrow for a word, or slim and tall."""
    w = x1 - x0
    return (w < NARROW) | ((w < SLIM) & ((y1 - y0) > w * TALL))


def in_rects(blocks: DataFrame, rects: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``blocks`` with ``inside``: whether more than the threshold of its area, which counts as 1 at least, lies in one rectangle of its page."""
    hit = tables.within(blocks.select("page_num", "block_idx", "x0", "y0", "x1", "y1"), rects, threshold).select("page_num", "l.block_idx").distinct()
    return blocks.join(hit.withColumn("__in", F.lit(True)), ["page_num", "block_idx"], "left").withColumn("inside", F.coalesce("__in", F.lit(False))).drop("__in")


def bands(blocks: DataFrame, width: float) -> DataFrame:
    """Runs of blocks, by height, that span the page or don't."""
    order = Window.partitionBy("page_num").orderBy("y0", "block_idx")
    full = (F.col("x1") - F.col("x0")) > width * 0.6
    b = blocks.withColumn("full", full).withColumn("new", F.coalesce((F.lag("full").over(order) != F.col("full")).cast("int"), F.lit(1)))
    b = b.withColumn("band", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return b.groupBy("page_num", "band", "full").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count("*").alias("blocks"))


def gaps(blocks: DataFrame) -> DataFrame:
    """Space below each block, at least 1.5; null for the last."""
    order = Window.partitionBy("page_num").orderBy("y0", "block_idx")
    nxt = F.lead("y0").over(order)
    return blocks.withColumn("gap", F.when(nxt.isNotNull(), F.greatest(nxt - F.col("y1"), F.lit(1.5))))


def columns(blocks: DataFrame, width: float) -> DataFrame:
    """(page_num, columns): left and right edges of each page's columns, one or two; without a block over a quarter of the page wide it is the page.

    There are two if such blocks begin, to the point, both left and right of a line 20
    points before the page's middle.
    """
    body = F.col("x1") - F.col("x0") > width * BODY_WIDTH
    at = F.when(body, F.bround("x0"))
    left, right = at < width / 2 - MIDDLE, at > width / 2 - MIDDLE
    edges = lambda test: F.struct(F.min(F.when(test, F.col("x0"))).alias("l"), F.max(F.when(test, F.col("x1"))).alias("r"))
    g = blocks.groupBy("page_num").agg(edges(left).alias("a"), edges(right).alias("b"), edges(body).alias("all"))
    page = F.struct(F.lit(0.0).alias("l"), F.lit(float(width)).alias("r"))
    found = F.when(F.col("all.l").isNull(), F.array(page)).when(F.col("a.l").isNotNull() & F.col("b.l").isNotNull(), F.array("a", "b")).otherwise(F.array("all"))
    return g.select("page_num", found.alias("columns"))


def body_size(blocks: DataFrame) -> DataFrame:
    """The most frequent font size (``size``) of the blocks to translate, to half a point; of equal ones the first seen, 10 without any."""
    s = blocks.where("translatable").select(F.struct("page_num", "block_idx").alias("at"), (F.bround(F.col("size") * 2) / 2).alias("size"))
    g = s.groupBy("size").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    return g.agg(F.coalesce(F.min_by("size", F.struct(-F.col("n"), "first")), F.lit(10.0)).alias("body_size"))
