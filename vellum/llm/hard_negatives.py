"""Hard negatives by segment summaries.

Every vector is kept with the mean and the deviation of each of its segments, at
levels of ever finer segments.  In one segment of length L two vectors' product lies
within L times (product of means plus or minus product of deviations), so sums over the
segments bound a score.  Pairs whose bounds can't enter a result any more are left out
level by level; scores are computed exactly only for those that no level ruled out.

The table stays where it lies.  Anchors are taken in blocks of BLOCK at most, each
sent to all tasks, and the tasks pass over the table twice: for the best positives, and,
once these are merged, for the best negatives between their limits.  A task keeps a few
best rows for each anchor, whose worst score is the limit for the next ones.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm.store import partitions, shared_dir, written

EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: A negative's score lies between these percentages of the positive's.
LEAST, MOST = 30, 90
#: Numbers of segments of the levels.
LEVELS = (1, 4, 16)
#: Anchors sent to the tasks at a time, and rows of a part of the table at most on average.
BLOCK, PART_ROWS = 16_384, 100_000
#: Anchors and rows whose bounds are held at a time, and the share of pairs left up to which these are looked at one by one.
TILE, SPARSE = (256, 2048), 1 / 8
#: Quantised components beyond this are cut to it, so that no score leaves 64 bits.
LARGEST = 1 << 26
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def summaries(q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the segments' means and deviations, both times the root of the segment's length."""
    out = []
    for n in LEVELS:
        parts = q.reshape(len(q), n, q.shape[1] // n).astype(np.float64)
        root = math.sqrt(parts.shape[2])
        out.append(((parts.mean(2) * root).astype(np.float32), (parts.std(2) * root).astype(np.float32)))
    return out


class Rows:
    """Vectors with their summaries, as the tasks hold them."""

    def __init__(self, ids, labels, vectors: list[bytes], notes: list[bytes]):
        n = len(vectors)
        self.ids, self.labels = np.asarray(ids, np.int64), np.asarray(labels, np.int64)
        self.q = np.frombuffer(b"".join(vectors), np.int32).reshape(n, -1)
        flat, self.levels, at = np.frombuffer(b"".join(notes), np.float32).reshape(n, 2 * sum(LEVELS)), [], 0
        for k in LEVELS:
            self.levels.append((flat[:, at : at + k], flat[:, at + k : at + 2 * k]))
            at += 2 * k
        mean, deviation = self.levels[0]
        self.norm = np.hypot(mean[:, 0], deviation[:, 0])

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, at) -> Rows:
        out = object.__new__(Rows)
        out.ids, out.labels, out.q, out.norm = self.ids[at], self.labels[at], self.q[at], self.norm[at]
        out.levels = [(m[at], d[at]) for m, d in self.levels]
        return out


class Best:
    """The k best rows of each of n anchors so far: higher scores first, of equal ones the lesser id."""

    def __init__(self, n: int, k: int):
        self.k, self.limit = k, np.full(n, LOWEST)
        self.of, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.limit[of]
        if not good.any():
            return
        of, score, ids = np.append(self.of, of[good]), np.append(self.score, score[good]), np.append(self.id, ids[good])
        order = np.lexsort((ids, -score, of))
        of = of[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        order, of = order[place < self.k], of[place < self.k]
        self.of, self.score, self.id = of, score[order], ids[order]
        full = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.limit[of[full]] = self.score[full]


def survivors(a: Rows, r: Rows, least: np.ndarray, most: np.ndarray, fits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, exact score) of the pairs with a score from ``least`` to ``most`` of the anchor, and of ``fits``.

    Bounds are rounded outwards by more than what single precision can lose.
    """
    left = np.ones((len(a), len(r)), bool) if fits is None else fits
    pairs = None
    for (am, ad), (rm, rd) in zip(a.levels, r.levels, strict=True):
        if pairs is None:
            middle, spread = am @ rm.T, ad @ rd.T + (1e-5 * a.norm[:, None] * r.norm + 1)
            left = left & (middle + spread >= least[:, None]) & (middle - spread <= most[:, None])
            if left.mean() <= SPARSE:
                pairs = np.nonzero(left)
        else:
            i, j = pairs
            middle, spread = np.einsum("ij,ij->i", am[i], rm[j]), np.einsum("ij,ij->i", ad[i], rd[j]) + (1e-5 * a.norm[i] * r.norm[j] + 1)
            ok = (middle + spread >= least[i]) & (middle - spread <= most[i])
            pairs = i[ok], j[ok]
    largest = float(np.abs(a.q).max(initial=0)) * float(np.abs(r.q).max(initial=0)) * a.q.shape[1]
    kind = np.float64 if largest < 2**53 else np.int64  # whole numbers below 2^53 are exact in double precision
    if pairs is None:
        pairs = np.nonzero(left)
        score = (a.q.astype(kind) @ r.q.T.astype(kind))[pairs]
    else:
        score = np.einsum("ij,ij->i", a.q[pairs[0]].astype(kind), r.q[pairs[1]].astype(kind))
    score = score.astype(np.int64)
    ok = (score >= least[pairs[0]]) & (score <= most[pairs[0]])
    return pairs[0][ok], pairs[1][ok], score[ok]


def _tiles(n: int, size: int) -> Iterator[slice]:
    return (slice(k, min(k + size, n)) for k in range(0, n, size))


def find_positives(anchors: Rows, batches: Iterator[Rows], k: int) -> Best:
    """The k best rows of the same label and another id of each anchor."""
    best, most = Best(len(anchors), k), np.full(len(anchors), HIGHEST)
    of_label = {x: np.flatnonzero(anchors.labels == x) for x in np.unique(anchors.labels)}
    for rows in batches:
        for x, own in of_label.items():
            same = rows.take(np.flatnonzero(rows.labels == x))
            for t in _tiles(len(own), TILE[0]):
                a = anchors.take(own[t])
                for u in _tiles(len(same), TILE[1]):
                    r = same.take(u)
                    i, j, score = survivors(a, r, best.limit[own[t]], most[own[t]], a.ids[:, None] != r.ids)
                    best.add(own[t][i], score, r.ids[j])
    return best


def limits(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most score of a negative to positives of these scores; none fits below zero."""
    return -(-LEAST * scores // 100), MOST * scores // 100


def find_negatives(anchors: Rows, batches: Iterator[Rows], positives: np.ndarray, given: np.ndarray, k: int) -> list[Best]:
    """For each place of a positive the k best rows of other labels within its limits; ``given`` tells which positives exist."""
    least, most = limits(positives)
    given = given & (least <= most)
    least, most = np.where(given, least, HIGHEST), np.where(given, most, LOWEST)
    bests = [Best(len(anchors), k) for _ in range(positives.shape[1])]
    for rows in batches:
        for t in _tiles(len(anchors), TILE[0]):
            a, lo, hi = anchors.take(t), least[t], most[t]
            for u in _tiles(len(rows), TILE[1]):
                now = np.maximum(lo, np.stack([b.limit[t] for b in bests], 1))
                r = rows.take(u)
                i, j, score = survivors(a, r, np.where(now <= hi, now, HIGHEST).min(1), hi.max(1), a.labels[:, None] != r.labels)
                for p, best in enumerate(bests):
                    ok = (score >= lo[i, p]) & (score <= hi[i, p])
                    best.add(i[ok] + t.start, score[ok], r.ids[j[ok]])
    return bests


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q, summary) of every row that takes part, written to the shared folder; rows alike in all of them count once."""
    x = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    q = F.transform(x, lambda x: F.greatest(F.least(F.floor(256 * x), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), q.alias("q"))
    n, width = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    width = -(-max(width or 0, 1) // LEVELS[-1]) * LEVELS[-1]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, flat = batch.column(2).value_lengths().to_numpy(), batch.column(2).flatten().to_numpy()
            q = np.zeros((batch.num_rows, width), np.int32)
            q[np.arange(width) < sizes[:, None]] = flat
            notes = np.concatenate([part for level in summaries(q) for part in level], 1)
            data = {"vec_id": batch.column(0), "label": batch.column(1), "q": pa.array([v.tobytes() for v in q], pa.binary()), "summary": pa.array([v.tobytes() for v in notes], pa.binary())}
            # copies within a batch go before they are shuffled
            yield from pa.table(data).group_by(list(data)).aggregate([]).to_batches()

    parts = max(partitions(vectors.sparkSession), -(-n // PART_ROWS))
    packed = rows.mapInArrow(pack, "vec_id long, label long, q binary, summary binary")
    return written(packed.repartition(parts, "vec_id", "label", "q").distinct(), "vectors")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    for batch in batches:
        if batch.num_rows:
            yield Rows(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3).to_pylist())


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = EVERY, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ranks from 1.

    Anchors are the rows whose vec_id is divisible by ``every``.  Rows without vec_id,
    label or vector, or with a component that is null or not finite, take no part; of
    rows alike in id, label and quantised vector one counts.  Rows that share an id only
    are rows of their own, but never each other's positive.  Vectors of different
    lengths are filled up with zeros.  Other columns are ignored.
    """
    table = prepared(vectors)
    spark = table.sparkSession
    asked = table.where(F.col("vec_id") % every == 0)
    n_blocks = -(-asked.count() // block)
    number = F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(max(n_blocks, 1)))
    path = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for b in range(n_blocks):
        rows = sorted(asked.where(number == b).collect())  # about ``block`` rows
        anchors = spark.sparkContext.broadcast(Rows([r.vec_id for r in rows], [r.label for r in rows], [bytes(r.q) for r in rows], [bytes(r.summary) for r in rows]))

        def near(batches: Iterator[pa.RecordBatch], anchors=anchors) -> Iterator[pa.RecordBatch]:
            best = find_positives(anchors.value, _read(batches), n_positives)
            yield pa.RecordBatch.from_arrays([pa.array(best.of), pa.array(best.id), pa.array(best.score)], ["anchor", "id", "score"])

        found = _first(table.mapInArrow(near, "anchor long, id long, score long"), ["anchor"], n_positives).collect()
        scores, ids, given = np.zeros((len(rows), n_positives), np.int64), np.zeros((len(rows), n_positives), np.int64), np.zeros((len(rows), n_positives), bool)
        for r in found:
            scores[r.anchor, r["rank"] - 1], ids[r.anchor, r["rank"] - 1], given[r.anchor, r["rank"] - 1] = r.score, r.id, True
        asked_for = spark.sparkContext.broadcast((scores, ids, given))

        def hard(batches: Iterator[pa.RecordBatch], anchors=anchors, asked_for=asked_for) -> Iterator[pa.RecordBatch]:
            scores, ids, given = asked_for.value
            for p, best in enumerate(find_negatives(anchors.value, _read(batches), scores, given, n_negatives)):
                columns = [best.of, np.full(len(best.of), p), anchors.value.ids[best.of], ids[best.of, p], scores[best.of, p], best.id, best.score]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "place", "anchor_id", "positive_id", "positive_score", "id", "score"])

        met = table.mapInArrow(hard, "anchor long, place long, anchor_id long, positive_id long, positive_score long, id long, score long")
        best = _first(met, ["anchor", "place"], n_negatives)
        best.selectExpr("anchor_id", "positive_id", "cast(rank as int) as rank", "id as negative_id", "positive_score", "score as negative_score").write.mode("append").parquet(path)
        anchors.destroy()
        asked_for.destroy()
    return spark.read.schema(schema).parquet(path)


ORACLE_SQL = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id as other_id, b.label as other_label,
    cast(list_inner_product(a.q, b.q) as bigint) as score
  from rows a join rows b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), positives as (
  select anchor_id, anchor_label, other_id as positive_id, score as positive_score from scored where other_label = anchor_label
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) as integer) as rank,
  s.other_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and s.other_label <> p.anchor_label
where 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) <= 10
"""
