"""Where blocks stand on a page: columns, neighbours, alignment, tables and drawings.

Blocks have page_num, block_idx and a box x0, y0, x1, y1; joins meet on the page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions.text import bound
from vellum.sources import views as V

# Alignments by number.
LEFT, CENTRE, RIGHT, JUSTIFIED = 0, 1, 2, 3


def block_format(lines: Column, x0: Column, x1: Column, page_width: Column) -> Column:
    """(align, indent) from the lines of a block, an array of (x0, x1) of those with text.

    A short line alone is centred if its margins agree.  Of three lines or more with even
    starts and ends (the last line's aside) it is justified; even middles make it centred,
    even ends flushed right; else it is left.  The first line's indent counts from 3 points.
    """
    bounds = F.struct(F.transform(lines, lambda s: s["x0"]).alias("starts"), F.transform(lines, lambda s: s["x1"]).alias("ends"))
    return bound(bounds, lambda t: _format(t["starts"], t["ends"], x0, x1, page_width))


def _format(starts: Column, ends: Column, x0: Column, x1: Column, page_width: Column) -> Column:
    """(align, indent) of a block whose lines have these starts and ends."""
    n = F.size(starts)
    spread = lambda a: F.coalesce(F.array_max(a) - F.array_min(a), F.lit(0.0))
    tolerance = F.greatest((x1 - x0) * 0.05, F.lit(4.0))
    even_starts = spread(starts) < tolerance
    even_ends = spread(F.when(n > 2, F.slice(ends, F.lit(1), n - 1)).otherwise(ends)) < tolerance
    even_middles = spread(F.zip_with(starts, ends, lambda a, z: (a + z) / 2)) < tolerance
    uneven = spread(starts) > tolerance
    first, last = F.get(starts, F.lit(0)), F.get(ends, F.lit(0))
    single = (last - first < page_width * 0.6) & (first > 20) & (F.abs(first - (page_width - last)) < page_width * 0.08)
    step = first - F.array_min(F.slice(starts, F.lit(2), F.greatest(n - 1, F.lit(1))))
    indent = F.when((n >= 2) & (step > 3), step).otherwise(0.0)
    align = (
        F.when(n == 0, LEFT)
        .when(n == 1, F.when(single, CENTRE).otherwise(LEFT))
        .when(even_starts & even_ends & (n >= 3), JUSTIFIED)
        .when(even_middles & uneven, CENTRE)
        .when(even_ends & uneven, RIGHT)
        .otherwise(LEFT)
    )
    return F.struct(align.alias("align"), F.when(align.isin(LEFT, JUSTIFIED), indent).otherwise(0.0).alias("indent"))


def column_of(x0: Column, x1: Column, columns: Column) -> Column:
    """The first of ``columns``, an array of (l, r), that holds the block's middle to 10 points, else the nearest; 0 of one or none."""
    mid = (x0 + x1) / 2
    holds = F.transform(columns, lambda c: (mid >= c["l"] - 10) & (mid <= c["r"] + 10))
    far = F.transform(columns, lambda c: F.abs(mid - (c["l"] + c["r"]) / 2))
    first = F.array_position(holds, F.lit(True))
    return F.when(F.size(columns) <= 1, 0).otherwise(F.when(first > 0, first).otherwise(F.array_position(far, F.array_min(far))) - 1).cast("int")


def next_below(blocks: DataFrame, page_height: float) -> DataFrame:
    """``blocks`` with ``next_y``: 2 above the next block below in the same column (``col``), at most 20 above the page's end.

    Starts and ends are put in one order of heights, where each end looks for the next start.
    """
    keys = ["page_num", "col"]
    starts = blocks.select(*keys, F.col("y0").cast("double").alias("__at"), F.lit(0).alias("__end"), F.lit(None).cast(blocks.schema["block_idx"].dataType).alias("block_idx"))
    ends = blocks.select(*keys, (F.col("y1") + 1).cast("double").alias("__at"), F.lit(1).alias("__end"), "block_idx")
    # of one height starts come first: a start has to lie beyond the end
    after = Window.partitionBy(*keys).orderBy("__at", "__end", "block_idx").rowsBetween(1, Window.unboundedFollowing)
    below = starts.unionByName(ends).withColumn("__y", F.min(F.when(F.col("__end") == 0, F.col("__at"))).over(after)).where("__end = 1").select(*keys, "block_idx", "__y")
    return blocks.join(below, [*keys, "block_idx"], "left").withColumn("next_y", F.least(F.lit(page_height - 20), F.coalesce(F.col("__y") - 2, F.lit(page_height - 20)))).drop("__y")


#: Blocks of a page up to which each looks through all of them; on larger pages they meet on grid cells.
FEW = 64


def room_below(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``max_y``: how far each may grow, to 1.5 above the next block that shares over 0.3 of the lesser width, at most by twice its height.

    On pages of up to 64 blocks nothing is joined.  Beyond, only blocks in reach of that
    growth are met, on grid cells.
    """
    page = Window.partitionBy("page_num")
    all_ = blocks.withColumn("__n", F.count("*").over(page))
    few = all_.where(F.col("__n") <= FEW).withColumn("__o", F.collect_list(F.struct("block_idx", "x0", "x1", "y0")).over(page))
    most = F.col("y1") + (F.col("y1") - F.col("y0")) * 2.0
    grows = F.col("page_num").isNotNull() & (F.col("x1") > F.col("x0")) & (most + 2 > F.col("y1"))

    def in_way(o: Column) -> Column:
        shared = F.least("x1", o["x1"]) - F.greatest("x0", o["x0"])
        narrow = F.least(F.col("x1") - F.col("x0"), o["x1"] - o["x0"])
        return (o["x1"] > o["x0"]) & (o["y0"] < most + 2) & (o["block_idx"] != F.col("block_idx")) & (o["y0"] > F.col("y1")) & (shared / narrow > 0.3)

    near = F.when(grows, F.array_min(F.transform(F.filter("__o", in_way), lambda o: o["y0"])))
    few = few.withColumn("max_y", F.least(most, F.coalesce(near - 1.5, most)))
    more = _room_on_cells(all_.where(F.col("__n") > FEW).drop("__n"), most)
    return few.select(*more.columns).unionByName(more)


def _room_on_cells(blocks: DataFrame, most: Column) -> DataFrame:
    from vellum.operators.tables import meeting_on_cells

    box = ["page_num", "block_idx", "x0", "x1"]
    reach = blocks.select(*box, (F.col("y1") - F.col("y0")).alias("h"), F.col("y1").alias("y0"), (most + 2).alias("y1"))
    tops = blocks.select(*box, "y0", (F.col("y0") + 1).alias("y1"))
    shared = F.least("l.x1", "r.x1") - F.greatest("l.x0", "r.x0")
    narrow = F.least(F.col("l.x1") - F.col("l.x0"), F.col("r.x1") - F.col("r.x0"))
    met = meeting_on_cells(reach, tops).where((F.col("l.block_idx") != F.col("r.block_idx")) & (F.col("r.y0") > F.col("l.y0")) & (shared / narrow > 0.3))
    near = met.groupBy("page_num", F.col("l.block_idx").alias("block_idx")).agg(F.min("r.y0").alias("__y"))
    return blocks.join(near, ["page_num", "block_idx"], "left").withColumn("max_y", F.least(most, F.coalesce(F.col("__y") - 1.5, most))).drop("__y")


def past_obstacles(y: Column, left: Column, right: Column, obstacles: Column, margin: float = 2.0, passes: int = 20) -> Column:
    """``y`` moved below every obstacle, an array of boxes, in whose reach it comes within the column; the list is gone through ``passes`` times at most."""
    meets = F.filter(obstacles, lambda o: (o["x1"] > left) & (o["x0"] < right))
    once = lambda at: F.aggregate(meets, at, lambda c, o: F.when((c >= o["y0"] - margin) & (c < o["y1"]), o["y1"] + margin).otherwise(c))
    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), y.cast("double"), lambda c, _: once(c))


def _covered(box: Column, by: Column) -> Column:
    """Whether over half of a box lies in another."""
    w = F.least(box["x1"], by["x1"]) - F.greatest(box["x0"], by["x0"])
    h = F.least(box["y1"], by["y1"]) - F.greatest(box["y0"], by["y0"])
    area = F.greatest((box["x1"] - box["x0"]) * (box["y1"] - box["y0"]), F.lit(1.0))
    return (w > 0) & (h > 0) & (w * h / area > 0.5)


def merged_rects(found: Column, more: Column) -> Column:
    """The boxes ``found`` and, in order, those of ``more`` that no box kept so far covers by half."""
    return F.aggregate(more, found, lambda kept, r: F.when(F.exists(kept, lambda k: _covered(r, k)), kept).otherwise(F.concat(kept, F.array(r))))


_BOX = "page_num long, x0 double, y0 double, x1 double, y1 double"


def _by_page(rows: DataFrame, many: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(page_num, x0, y0, x1, y1): what ``many`` makes of the pages of a batch: of their boxes, an array of four columns, and of the cuts between pages it gives for each box that it makes the number of its page, from 0, and the box; a page's rows are read together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages, boxes = np.zeros(0, np.int64), np.zeros((0, 4))

        def made(cuts: np.ndarray) -> pa.RecordBatch:
            of, out = many(boxes[: cuts[-1]], cuts)
            cells = [pages[cuts[of]], *out.T]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, [pa.int64()] + [pa.float64()] * 4, strict=True)], ["page_num", "x0", "y0", "x1", "y1"])

        for batch in batches:
            pages = np.concatenate([pages, batch.column(0).to_numpy()])
            boxes = np.concatenate([boxes, np.stack([batch.column(i).to_numpy() for i in range(1, 5)], 1)])
            cuts = np.flatnonzero(np.r_[True, pages[1:] != pages[:-1]]) if len(pages) else np.zeros(1, np.int64)
            yield made(cuts)  # the last page may go on
            pages, boxes = pages[cuts[-1] :], boxes[cuts[-1] :]
        if len(pages):
            yield made(np.array([0, len(pages)]))

    boxes = rows.select(F.col("page_num").cast("long"), *(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))).dropna()
    return boxes.repartition("page_num").sortWithinPartitions("page_num").mapInArrow(run, _BOX)


def _one_by_one(one: Callable[[np.ndarray], list[tuple]]) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For ``_by_page``: ``one`` makes the boxes of a page."""

    def many(boxes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = [(k, *box) for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) for box in one(boxes[a:z])]
        told = np.array(out, float).reshape(-1, 5)
        return told[:, 0].astype(np.int64), told[:, 1:]

    return many


def ruled_tables(lines: DataFrame) -> DataFrame:
    """Boxes of tables from drawn lines (page_num, x0, y0, x1, y1), page by page.

    Level lines from 20 points, top down, form a run with the first one left: they share 0.7
    of its span and follow at most 60 below the run's last.  Three make a table if two
    upright lines from 5 points cross its box, 2 points aside.
    """

    def one(page: np.ndarray) -> list[tuple]:
        x, y = np.sort(page[:, [0, 2]], 1), np.sort(page[:, [1, 3]], 1)
        wide, high = np.diff(x).ravel(), np.diff(y).ravel()
        level = (high < 0.5) & (wide >= 20)
        upright = ~level & (wide < 0.5) & (high >= 5)
        vx, vy = x[upright].mean(1), y[upright]
        order = np.argsort(y[level].mean(1), kind="stable")
        at, span = y[level].mean(1)[order], x[level][order]
        left, out = np.ones(len(at), bool), []
        while left.any() and len(at) >= 3 and len(vx) >= 2:
            i = int(np.argmax(left))
            inter = np.minimum(span[:, 1], span[i, 1]) - np.maximum(span[:, 0], span[i, 0])
            union = np.maximum(span[:, 1], span[i, 1]) - np.minimum(span[:, 0], span[i, 0])
            run, last = [i], at[i]
            for j in np.flatnonzero(left & (np.arange(len(at)) > i) & (union > 0) & (inter >= 0.7 * union)):
                if abs(at[j] - last) <= 60:
                    run.append(int(j))
                    last = at[j]
            left[run] = False
            x0, x1, y0, y1 = span[run, 0].min(), span[run, 1].max(), at[run].min(), at[run].max()
            crossing = (vx >= x0 - 2) & (vx <= x1 + 2) & (vy[:, 0] <= y1 + 2) & (vy[:, 1] >= y0 - 2)
            if len(run) >= 3 and crossing.sum() >= 2:
                out.append((x0, y0, x1, y1))
        return out

    return _by_page(lines, _one_by_one(one))


def is_coloured(stroke: Column, fill: Column) -> Column:
    """A drawing with a stroke in colour or a fill that isn't white; both are arrays of three shares or null."""
    high, low = F.array_max(stroke), F.array_min(stroke)
    return F.coalesce((low < 0.95) & (high - low > 0.1), F.lit(False)) | F.coalesce((F.size(fill) >= 3) & F.exists(F.slice(fill, 1, 3), lambda c: c < 0.98), F.lit(False))


#: Shapes of a page up to which it is taken with others of as many, and pairs of shapes that are looked at together.
SMALL, PAIRS = 64, 1 << 20


def diagrams(shapes: DataFrame, least: int = 3, least_size: float = 80.0, near: float = 30.0) -> DataFrame:
    """Boxes, 4 points wider, of groups of ``least`` shapes or more that come within ``near`` of one another, page by page.

    Shapes under 2 points either way don't count, nor do groups under ``least_size`` either way.
    Pages of up to 64 shapes are taken together with those of as many, some thousand at a time.
    """

    def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (b[..., 0] < a[..., 2] + near) & (b[..., 2] > a[..., 0] - near) & (b[..., 1] < a[..., 3] + near) & (b[..., 3] > a[..., 1] - near)

    def boxed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.concatenate([low - 4, high + 4], -1)

    def one(b: np.ndarray) -> list[tuple]:
        label = np.arange(len(b))
        for i, shape in enumerate(b):  # a row at a time, never all pairs at once
            meets = meet(shape, b)
            meets[i] = True
            joined = np.isin(label, label[meets])
            label[joined] = label[joined].min()
        groups = (b[label == k] for k in np.flatnonzero(np.bincount(label) >= least))
        return [tuple(boxed(g[:, :2].min(0), g[:, 2:].max(0))) for g in groups if (g[:, 2:].max(0) - g[:, :2].min(0) >= least_size).all()]

    def alike(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pages of as many shapes each, (page, shape, side): the page of each group, and its box."""
        n = b.shape[1]
        near_by = meet(b[:, :, None], b[:, None])
        near_by |= near_by.transpose(0, 2, 1) | np.eye(n, dtype=bool)
        label = np.broadcast_to(np.arange(n), b.shape[:2])
        while True:  # the least number in reach goes on until none changes
            less = np.where(near_by, label[:, None], n).min(2)
            if (less == label).all():
                break
            label = less
        mine = label[:, None] == np.arange(n)[:, None]  # page, group, shape
        low = np.where(mine[..., None], b[:, None, :, :2], np.inf).min(2)
        high = np.where(mine[..., None], b[:, None, :, 2:], -np.inf).max(2)
        page, group = np.nonzero((mine.sum(2) >= least) & (high - low >= least_size).all(2))
        return page, boxed(low[page, group], high[page, group])

    def many(boxes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(cuts)
        out = [(np.zeros(0, np.int64), np.zeros((0, 4)))]
        for n in np.unique(sizes[sizes >= max(least, 1)]):
            of = np.flatnonzero(sizes == n)
            if n > SMALL:
                out += [(np.full(len(found), k), np.array(found, float).reshape(-1, 4)) for k in of for found in [one(boxes[cuts[k] : cuts[k + 1]])]]
                continue
            for some in np.array_split(of, -(-len(of) * n * n // PAIRS)):
                page, found = alike(boxes[cuts[some][:, None] + np.arange(n)])
                out.append((some[page], found))
        of, found = (np.concatenate(x) for x in zip(*out, strict=True))
        return of, found

    return _by_page(shapes.where("x1 - x0 >= 2 and y1 - y0 >= 2"), many)


def boxes(spark, d) -> DataFrame:
    """Line items as blocks of pages: the order is the page, the rest gives the place on it and the box by rule."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    t = V.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", place.alias("l_linenumber"))
    x0, y0 = F.col("l_partkey") % 5 * 100 + 20.0, F.col("l_quantity") * 12.0
    return t.select(F.col("l_orderkey").alias("page_num"), F.col("l_linenumber").cast("int").alias("block_idx"), x0.alias("x0"), y0.alias("y0"), (x0 + 60 + F.col("l_suppkey") % 4 * 60).alias("x1"), (y0 + 10 + F.col("l_linenumber") % 3 * 12).alias("y1"))


_COLUMNS = [(20.0, 190.0), (210.0, 400.0), (430.0, 560.0)]


def _columns() -> Column:
    return F.array(*(F.struct(F.lit(a).alias("l"), F.lit(b).alias("r")) for a, b in _COLUMNS))


def _with_column(spark, d) -> DataFrame:
    b = boxes(spark, d)
    return b.withColumn("col", column_of(F.col("x0"), F.col("x1"), _columns()))


def _formats(spark, d) -> DataFrame:
    lines = F.transform(F.sequence(F.lit(0), F.col("block_idx") % 5), lambda i: F.struct((F.col("x0") + F.when(i == 0, F.col("page_num") % 3 * 5).otherwise(F.col("page_num") % 4 * i)).alias("x0"), (F.col("x1") - F.col("block_idx") % 3 * i * 4).alias("x1")))
    b = boxes(spark, d)
    return b.select("page_num", "block_idx", block_format(lines, F.col("x0"), F.col("x1"), F.lit(600.0)).alias("f")).select("page_num", "block_idx", "f.*")


def _obstacles(spark, d) -> DataFrame:
    b = boxes(spark, d)
    each = b.groupBy("page_num").agg(F.array_sort(F.collect_list(F.struct("block_idx", "x0", "y0", "x1", "y1"))).alias("o"))
    return each.select("page_num", past_obstacles(F.lit(100.0), F.lit(100.0), F.lit(300.0), F.col("o")).alias("y"))


QUERIES = {
    "block_columns": lambda spark, d: _with_column(spark, d).select("page_num", "block_idx", "col"),
    "block_next_below": lambda spark, d: next_below(_with_column(spark, d), 842.0).select("page_num", "block_idx", "next_y"),
    "block_room_below": lambda spark, d: room_below(boxes(spark, d)).select("page_num", "block_idx", "max_y"),
    "block_formats": _formats,
    "page_diagrams": lambda spark, d: diagrams(boxes(spark, d)),
    "past_obstacles": _obstacles,
}

_B = "b as (select l_orderkey as page_num, l_linenumber::int as block_idx, l_partkey % 5 * 100 + 20.0::double as x0, l_quantity * 12.0::double as y0, l_partkey % 5 * 100 + 20.0::double + 60 + l_suppkey % 4 * 60 as x1, l_quantity * 12.0::double + 10 + l_linenumber % 3 * 12 as y1 from (select * replace (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as l_linenumber) from lineitem))"
_C = f"""{_B}, k as (select *, case {' '.join(f'when (x0 + x1) / 2 between {a - 10} and {b + 10} then {i}' for i, (a, b) in enumerate(_COLUMNS))}
  else (select arg_min(i, abs((x0 + x1) / 2 - mid)) from (values {', '.join(f'({i}, {(a + b) / 2})' for i, (a, b) in enumerate(_COLUMNS))}) v(i, mid)) end::int as col from b)"""
ORACLE_SQL = {
    "block_columns": f"with {_C} select page_num, block_idx, col from k",
    "block_next_below": f"with {_C} select a.page_num, a.block_idx, least(822.0, coalesce(min(o.y0) - 2, 822.0))::double as next_y from k a left join k o on o.page_num = a.page_num and o.col = a.col and o.block_idx <> a.block_idx and o.y0 > a.y1 + 1 group by 1, 2",
    "block_room_below": f"""with {_B} select a.page_num, a.block_idx, any_value(least(a.y1 + (a.y1 - a.y0) * 2, coalesce(o.y - 1.5, a.y1 + (a.y1 - a.y0) * 2))) as max_y from b a left join lateral (
  select min(y0) as y from b o where o.page_num = a.page_num and o.block_idx <> a.block_idx and o.y0 > a.y1 and (least(a.x1, o.x1) - greatest(a.x0, o.x0)) / least(a.x1 - a.x0, o.x1 - o.x0) > 0.3) o on true group by 1, 2""",
    "past_obstacles": f"""with recursive {_B}, m as (select page_num, row_number() over (partition by page_num order by block_idx, x0) as k, y0, y1 from b where x1 > 100 and x0 < 300),
n as (select page_num, count(*) as n from m group by 1), p as (select distinct page_num from b),
r as (select page_num, 0 as step, 100.0::double as y from p
  union all select r.page_num, step + 1, case when r.y >= m.y0 - 2 and r.y < m.y1 then m.y1 + 2 else r.y end from r join n using (page_num) join m on m.page_num = r.page_num and m.k = step % n.n + 1 where step < 20 * n.n)
select page_num, arg_max(y, step) as y from r group by 1""",
    "block_formats": f"""with {_B}, l as (select page_num, block_idx, x0, x1, i, x0 + case when i = 0 then page_num % 3 * 5 else page_num % 4 * i end as a, x1 - block_idx % 3 * i * 4 as z, block_idx % 5 + 1 as n
  from (select *, unnest(range(0, block_idx % 5 + 1)) as i from b)),
g as (select page_num, block_idx, any_value(n) as n, greatest(any_value(x1 - x0) * 0.05, 4.0) as tol, max(a) - min(a) as sa, coalesce(max(z) filter (n <= 2 or i < n - 1) - min(z) filter (n <= 2 or i < n - 1), 0) as sz,
  max((a + z) / 2) - min((a + z) / 2) as sm, any_value(a) filter (i = 0) as fa, any_value(z) filter (i = 0) as fz, any_value(a) filter (i = 0) - min(a) filter (i > 0) as step from l group by 1, 2),
f as (select *, case when n = 1 then case when fz - fa < 360 and fa > 20 and abs(fa - (600 - fz)) < 48 then 1 else 0 end when sa < tol and sz < tol and n >= 3 then 3 when sm < tol and sa > tol then 1 when sz < tol and sa > tol then 2 else 0 end as align from g)
select page_num, block_idx, align, case when align in (0, 3) and n >= 2 and step > 3 then step else 0.0 end::double as indent from f""",
    "page_diagrams": f"""with recursive {_B}, e as (select a.page_num, a.block_idx as i, o.block_idx as j from b a join b o on o.page_num = a.page_num and o.x0 < a.x1 + 30 and o.x1 > a.x0 - 30 and o.y0 < a.y1 + 30 and o.y1 > a.y0 - 30),
r as (select page_num, i, j from e union select r.page_num, r.i, e.j from r join e on e.page_num = r.page_num and e.i = r.j),
g as (select page_num, i, min(j) as root from r group by 1, 2)
select page_num, min(x0) - 4 as x0, min(y0) - 4 as y0, max(x1) + 4 as x1, max(y1) + 4 as y1 from (select g.root, b.* from g join b on b.page_num = g.page_num and b.block_idx = g.i) group by page_num, root
having count(*) >= 3 and max(x1) - min(x0) >= 80 and max(y1) - min(y0) >= 80""",
}
