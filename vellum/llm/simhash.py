"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints: one bit per position, set if more than half of the document's
3-word shingles (repeats included) have it set in their XXH64 with seed 42.

Links: pairs of distinct fingerprints that differ in at most three bits.  Of four
16-bit blocks one must then agree, so each fingerprint enters four tries, rotated
to put another block first; below a shared block the trie is joined with itself:
pairs of nodes go down together, each level adds the bits in which they differ,
and a pair over the budget is dropped with everything below it.  A block value
with many fingerprints is salted: its rows are dealt over s parts and each pair
of parts is a task of its own.  Tasks return a spanning forest of what they
linked, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.components import connected_components
from vellum.llm.store import partitions, written

BITS, BLOCK, BUDGET = 64, 16, 3
#: Fingerprints of one block value that a task takes whole; beyond, parts of half that size.
GROUP = 2048
#: Node pairs that are open at once, and pairs of leaves under two nodes that are compared directly.
OPEN, DIRECT = 100_000, 8


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of one text; 0 for null and for a text without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[i:j], 42) for i, j in spans), np.uint64, len(words) - shingle + 1)
    n = len(hashes)
    total = np.zeros(BITS, np.int64)
    for k in range(0, n, 65_536):
        bits = np.unpackbits(hashes[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.int64 if n < 256 else np.int32)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def trie_pairs(keys: np.ndarray, roots: list[tuple[int, int, int, int]], top: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``keys`` within ``budget`` bits, a few at a time.

    ``keys`` are sorted within each node; a root (a0, a1, b0, b1) joins two node
    ranges, or one with itself; ``top`` is the highest bit in which they may differ.
    """
    todo = [(np.array(roots, np.int64).reshape(-1, 4), np.zeros(len(roots), np.int64), top)]
    while todo:
        node, err, bit = todo.pop()
        if len(node) > OPEN:
            todo += [(node[OPEN:], err[OPEN:], bit)]
            node, err = node[:OPEN], err[:OPEN]
        a0, a1, b0, b1 = node.T
        same = a0 == b0
        small = (a1 - a0) * (b1 - b0) <= DIRECT
        if bit < 0:
            small[:] = True
        if small.any():
            yield from _direct(keys, node[small], same[small], budget)
            node, err, same = node[~small], err[~small], same[~small]
            a0, a1, b0, b1 = node.T
        if not len(node):
            continue
        ma, mb = _middle(keys, a0, a1, bit), _middle(keys, b0, b1, bit)
        left_left = np.stack([a0, ma, b0, mb], 1)
        right_right = np.stack([ma, a1, mb, b1], 1)
        left_right = np.stack([a0, ma, mb, b1], 1)
        right_left = np.stack([ma, a1, b0, mb], 1)[~same]
        node = np.concatenate([left_left, right_right, left_right, right_left])
        err = np.concatenate([err, err, err + 1, err[~same] + 1])
        alone = (node[:, 0] == node[:, 2]) & (node[:, 1] - node[:, 0] == 1)
        keep = (err <= budget) & (node[:, 1] > node[:, 0]) & (node[:, 3] > node[:, 2]) & ~alone
        if keep.any():
            todo.append((node[keep], err[keep], bit - 1))


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """The first place in each range [lo, hi) whose key has ``bit`` set; keys of a node agree above it."""
    lo, hi = lo.copy(), hi.copy()
    shift = np.uint64(bit)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = (keys[np.minimum(mid, len(keys) - 1)] >> shift) & np.uint64(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _direct(keys: np.ndarray, node: np.ndarray, same: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k in range(0, len(node), OPEN):
        a0, a1, b0, b1 = node[k : k + OPEN].T
        wide = b1 - b0
        n = (a1 - a0) * wide
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        i, j = a0[row] + step // wide[row], b0[row] + step % wide[row]
        near = (np.bitwise_count(keys[i] ^ keys[j]) <= budget) & (~same[k : k + OPEN][row] | (i < j))
        yield i[near], j[near]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index connected to each of n, by ``pairs``."""
    label = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (up := label[label]).tobytes() != label.tobytes():
                label = up
    return label


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of each task key; a key's rows are consecutive."""

    def solve(key: np.ndarray, key2: np.ndarray, fp: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        fp = fp.view(np.uint64)
        turn = (key2 >> 50).astype(np.uint64) * np.uint64(BLOCK)
        turned = np.where(turn == 0, fp, (fp << turn) | (fp >> (np.uint64(BITS) - turn) % np.uint64(BITS)))
        order = np.lexsort((turned, side, key2, key))
        turned, side, key, key2, fp = turned[order], side[order], key[order], key2[order], fp[order]
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (key2[1:] != key2[:-1])])
        roots = []
        for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True):
            m = a + int(np.searchsorted(side[a:z], 1))
            if m in (a, z):
                if z - a > 1 and key2[a] & 1 == 0:
                    roots.append((a, z, a, z))
            else:
                roots.append((a, m, m, z))
        label = forest(len(fp), trie_pairs(turned, roots, BITS - BLOCK - 1, BUDGET)) if roots else np.arange(len(fp))
        linked = label != np.arange(len(fp))
        out = [pa.array(fp[linked].view(np.int64)), pa.array(fp[label[linked]].view(np.int64))]
        return pa.RecordBatch.from_arrays(out, ["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held.append(now)
        if sum(len(x[0]) for x in held) < 50_000:
            continue
        key, key2, fp, side = (np.concatenate(c) for c in zip(*held, strict=True))
        last = int(np.flatnonzero((key != key[-1]) | (key2 != key2[-1]))[-1]) + 1 if (key != key[-1]).any() or (key2 != key2[-1]).any() else 0
        if last:
            yield solve(key[:last], key2[:last], fp[:last], side[:last])
        held = [[key[last:], key2[last:], fp[last:], side[last:]]]
    if held and len(held[0][0]):
        yield solve(*(np.concatenate(c) for c in zip(*held, strict=True)))


def links(prints: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` within the budget."""
    spark = prints.sparkSession
    turned = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS // BLOCK - 1))).alias("turn"))
    block = F.expr(f"shiftrightunsigned(fp, {BITS - BLOCK} - turn * {BLOCK}) & {2**BLOCK - 1}L")
    turned = turned.select("fp", (F.col("turn") * 2**BLOCK + block).alias("key"))
    large = turned.groupBy("key").count().where(F.col("count") > group).select("key", F.ceil(F.col("count") / (group // 2)).alias("parts"))
    at = turned.join(large, "key", "left").withColumn("part", F.expr("pmod(xxhash64(fp, 7), coalesce(parts, 1))"))
    dealt = at.select("fp", "key", "part", F.explode(F.expr("sequence(0L, coalesce(parts, 1) - 1)")).alias("other"))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    # key2: the turn in the top bits, then the two parts, then whether two parts meet
    dealt = dealt.select(
        "key",
        F.expr("shiftleft(shiftright(key, 16), 50)").bitwiseOR(F.shiftleft(low, 26)).bitwiseOR(F.shiftleft(high, 1)).bitwiseOR((low != high).cast("long")).alias("key2"),
        "fp",
        (F.col("part") > F.col("other")).cast("int").alias("side"),
    )
    dealt = dealt.repartition(partitions(spark), "key", "key2").sortWithinPartitions("key", "key2")
    return dealt.mapInArrow(_link, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every document.

    component_id is the least doc_id reachable over links, the document itself
    included.  Texts without a word (null, empty, blank) share fingerprint 0, which
    links like any other.  A repeated doc_id keeps all its rows; an empty table
    gives an empty result; other columns are ignored.
    """
    prints = written(fingerprints(docs), "fingerprints")
    by_print = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    group = connected_components(links(by_print.select("fp")))
    placed = by_print.join(group.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return prints.join(placed.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id.

    Rows with a null doc_id are kept; of repeated rows with one doc_id all stay.
    """
    found = near_duplicates(docs.where("doc_id is not null"))
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
