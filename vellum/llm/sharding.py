"""Shuffled shards by a two-pass external shuffle.

Pass one counts; then every record is scattered to a bucket by a seeded hash, so
that each bucket holds a uniform sample small enough for a task's memory.  Rows that
repeat so often that their copies would fill a bucket are counted first, kept once and
dealt out copy by copy.  Pass two sorts each bucket by its records' identity, shuffles it by Fisher-Yates with a
generator seeded by the bucket, and gives each record its place in the whole order.
Shards are equal runs of that order: their row counts are at most one apart.  Both
passes depend only on the rows and the seed, so a task that runs again gives the
same places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vellum.llm.store import partitions, written

BUCKET_BYTES = 32 << 20
#: Repeated rows that would take more than this part of a bucket are dealt out copy by copy, so many in a row at once.
HOT_PART, COPIES = 8, 10_000
#: Hot rows up to which a list of their hashes, 16 bytes each, is broadcast.
BROADCAST_ROWS = 500_000
#: Buckets of a run, whose counts are added up apart.
RUN = 1024
#: Rows that a task hands on at once.
CHUNK = 2_000


def _shuffle(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def deal() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            start = whole["__start"][0].as_py()
            order = np.random.Generator(np.random.PCG64([seed, now])).permutation(len(whole))
            plain = whole.drop_columns(["__bucket", "__start"])
            for k in range(0, len(order), CHUNK):
                part = plain.take(pa.array(order[k : k + CHUNK])).append_column("position", pa.array(np.arange(start + k, start + k + len(order[k : k + CHUNK]))))
                yield from part.combine_chunks().to_batches()

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("__bucket")).to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if held and ids[a] != now:
                    yield from deal()
                    held = []
                now = int(ids[a])
                held.append(batch.slice(a, z - a))
        if held:
            yield from deal()

    return run


def _identified(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with two hashes of all columns, 128 bits, that tell whole rows apart."""
    whole = [F.to_json(F.struct(f.name)) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return docs.withColumns({"__a": F.xxhash64(F.lit(seed), *whole), "__b": F.xxhash64(*whole, F.lit(~seed))})


def _spread(docs: DataFrame, bucket_bytes: int) -> DataFrame:
    """Rows with the number of their copy, ``__copy``: 0, but for rows whose copies would crowd a bucket."""
    keys = ["__a", "__b"]
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    hot = docs.groupBy(*keys).agg(F.count("*").alias("__n"), F.sum(size).alias("bytes")).where(F.col("bytes") > bucket_bytes // HOT_PART).where("__n > 1").select(*keys, "__n")
    hot = written(hot, "hot")
    n = hot.count()
    if not n:
        return docs.withColumn("__copy", F.lit(0).cast("long"))
    hot = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
    rest = docs.join(hot, keys, "left_anti").withColumn("__copy", F.lit(0).cast("long"))
    own = [c for c in docs.columns if c not in keys]
    once = docs.join(hot, keys).groupBy(*keys, "__n").agg(F.first(F.struct(*(f"`{c}`" for c in own))).alias("__row"))
    runs = once.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {COPIES}")))).repartition(partitions(docs.sparkSession), *keys, "__run")
    copy = F.explode(F.sequence(F.col("__run") * COPIES, F.least((F.col("__run") + 1) * COPIES, F.col("__n")) - 1))
    each = runs.select(*(F.col("__row")[c].alias(c) for c in own), *keys, copy.alias("__copy"))
    return rest.select(*own, *keys, "__copy").unionByName(each)


def shuffled(docs: DataFrame, seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """``docs`` with ``position``, its place from 0 in a uniform shuffle, and the number of rows.

    Every row of the input comes out once, with all its columns; an own column named
    position is replaced.  Places depend on the rows and the seed only; rows that are equal
    in all columns can't be told apart.  Nulls are hashed like other values.  Own columns
    named __bucket, __start, __a, __b, __copy or __n are left out.
    """
    spark = docs.sparkSession
    docs = docs.drop("position", "__bucket", "__start", "__a", "__b", "__copy", "__n")
    total = docs.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()
    buckets = max(partitions(spark), -(-(total[1] or 0) // bucket_bytes))
    keys = ["__a", "__b", "__copy"]
    scattered = _spread(_identified(docs, seed), bucket_bytes).withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    counts = scattered.groupBy("__bucket").agg(F.count("*").alias("n"))
    # places before each bucket: within runs of RUN buckets, and before the runs, of which one order is made
    counts = counts.withColumn("__run", F.expr(f"__bucket div {RUN}"))
    runs = counts.groupBy("__run").agg(F.sum("n").alias("run_n"))
    runs = runs.select("__run", (F.sum("run_n").over(Window.orderBy("__run")) - F.col("run_n")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("__run").orderBy("__bucket")) - F.col("n")
    starts = counts.withColumn("within", within).join(runs, "__run").select("__bucket", (F.col("within") + F.col("before")).alias("__start"))
    starts = F.broadcast(starts) if buckets <= BROADCAST_ROWS else starts
    # a bucket is a partition: its number, not a hash of it, says where it goes
    dealt = scattered.repartitionById(buckets, F.col("__bucket")).join(starts, "__bucket")
    dealt = dealt.sortWithinPartitions("__bucket", *keys).select(*docs.columns, "__bucket", "__start")
    schema = T.StructType([*docs.schema.fields, T.StructField("position", T.LongType())])
    return dealt.mapInArrow(_shuffle(seed), schema), total[0]


def shards(docs: DataFrame, n_shards: int = 24, seed: int = 11) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, gapless from 0 in each shard.

    Row counts of shards are at most one apart; with fewer rows than shards some
    shards are empty.  Own columns named shard, slot or position are replaced.
    """
    placed, n = shuffled(docs.drop("shard", "slot"), seed)
    shard = F.expr(f"cast(position * {n_shards} div {max(n, 1)} as int)")
    return placed.withColumn("shard", shard).withColumn("slot", F.expr(f"position - (shard * {n}L + {n_shards - 1}) div {n_shards}")).drop("position")


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, seed: int = 11) -> None:
    """Writes each shard as a folder of its own; ``slot`` keeps the order within it."""
    shards(docs, n_shards, seed).write.partitionBy("shard").parquet(path)
