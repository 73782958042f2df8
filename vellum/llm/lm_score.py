"""Scores of documents under a hierarchical Pitman-Yor bigram model.

Every word is the context of a restaurant whose dishes are the words after it; all
context restaurants share one parent, the unigram restaurant, whose own parent is
uniform over the vocabulary and one unknown word.

Seating is sampled by Gibbs in ROUNDS, from one table for each dish.  In each, every dish of every restaurant is
seated anew: its number of tables is drawn from the full conditional given all other
restaurants as they stood after the round before, that is with probability in
proportion to new^t S(c, t), where S is the generalised Stirling number and ``new`` the
weight of a new table (strength and discount times the tables of the restaurant, times
the parent's probability).  Tables sent up are the parent's customers, and the parent is
seated in the same way.  The predictive probabilities of all rounds after the first are
averaged.

The corpus is cut into blocks of whole documents, kept as arrays in a bucketed table.
Counts come together in exchanges, each of the same form: a block asks shards,
dealt by hash, with the sorted keys it holds, shards add up what all blocks sent and
answer in the order asked.

* words: training counts of each word;
* pairs: training counts of each context and word, and which block accounts for it;
* tables, once a round: what the sampled seating sends up: tables by context, customers
  by word.

Draws are seeded by pair and round, so every block that holds a pair finds the same
seating, and so does a task that runs again.  Restaurants of one round are drawn at once,
not one after the other (as in distributed topic models).  Words are known by 64-bit
hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.store import bucketed, partitions
from vellum.llm.words import iter_slices, mix

#: Bytes of text in a block, and keys that a shard gets if all are spread evenly.
BLOCK_BYTES, SHARD_KEYS = 2 << 20, 1_500_000
#: Times that all restaurants are seated; the first, one table for each dish, is left out of the mean of the probabilities.
ROUNDS = 3
#: Customers of a dish up to which Stirling numbers are tabled; beyond, their limit in the count is used.
TABLED = 1_024
#: Ratio of a new table's weight and the discount beyond which dishes of more customers than that are drawn by a normal law.
MANY = 300.0
STRENGTH = 1.0
END = np.uint64(0x5DEECE66D1234567)
START = np.uint64(0x2545F4914F6CDD1D)
_ASK = "shard int, block long, m int, keys binary, values binary, apart binary"
#: What shards answer: a word's count and whether several blocks have it; a pair's count; tables by context and by word and of the unigram restaurant; each with who accounts for it.
WORD_KINDS, PAIR_KINDS, TABLE_KINDS = ("<i8", "u1", "u1"), ("<i8", "u1"), ("<i8", "<i8", "<i8", "u1")
_TOLD = "block long, shard int, m int, answer binary, n double, types double, ones double, twos double"


# ---- blocks ---------------------------------------------------------------------


def blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_ids, held, lengths, vocabulary, tokens), written in buckets by block."""
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    rows = docs.select(F.col("doc_id").cast("long"), held.alias("held"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).fill_null(-(2**63)).to_numpy()
            out = batch.column(1).to_numpy(zero_copy_only=False)
            for w in iter_slices(batch.column(2), lower=True, slice_bytes=BLOCK_BYTES):
                n = np.diff(w.offsets) + 1
                all_hashes = np.insert(w.hashes, w.offsets[1:], END)
                vocabulary, tokens = np.unique(all_hashes, return_inverse=True)
                own = slice(w.first_row, w.first_row + w.n_docs)
                cells = [ids[own], out[own].astype(np.uint8), n.astype(np.int32), vocabulary, tokens.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], ["block", "doc_ids", "held", "lengths", "vocabulary", "tokens"])
                block += 1

    return bucketed(rows.mapInArrow(run, "block long, doc_ids binary, held binary, lengths binary, vocabulary binary, tokens binary"), "block", "lm_blocks")


class Block:
    """One row of the table as arrays."""

    def __init__(self, row: dict):
        self.id = row["block"]
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.tokens = np.frombuffer(row["tokens"], np.int32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.train = ~self.held[self.doc]

    def paired(self) -> Block:
        """With its pairs of context and word, in order; the start is the context after the vocabulary."""
        v = len(self.vocabulary)
        before = np.concatenate(([v], self.tokens[:-1])) if len(self.tokens) else self.tokens
        before[(np.cumsum(self.lengths) - self.lengths)[: len(self.lengths)]] = v
        self.pairs, self.pair_of = np.unique(before * (v + 1) + self.tokens, return_inverse=True)
        self.u, self.w = self.pairs // (v + 1), self.pairs % (v + 1)
        self.local = np.bincount(self.pair_of[self.train], minlength=len(self.pairs))
        names = np.append(self.vocabulary, START)
        self.pair_hash = mix(names[self.u] * np.uint64(0x9E3779B97F4A7C15) + mix(names[self.w] + np.uint64(1)))
        return self

    def open_pairs(self, c: np.ndarray, shared: np.ndarray, n_docs: float, n_blocks: int) -> np.ndarray:
        """Places of the pairs that another block may hold too, by hash.

        A pair trained here goes out if other blocks have both words, in training or
        held-out rows, for those ask for it; one that isn't, if others train both.
        """
        here = np.append(np.bincount(self.tokens[self.train], minlength=len(c)), int((~self.held).sum()))
        trained = np.append(c, int(n_docs)) > here
        held = np.append(shared.astype(bool), n_blocks > 1)
        may = np.where(self.local > 0, held[self.u] & held[self.w], trained[self.u] & trained[self.w])
        at = np.flatnonzero(may)
        return at[np.argsort(self.pair_hash[at])]


# ---- exchanges ------------------------------------------------------------------


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of one length, byte by byte: first bytes of all, second bytes of all, so that high bytes, mostly zero, take no room."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays if len(a)]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True) if planes else b""


def _unpack(packed: bytes, kinds: tuple[str, ...], m: int) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    raw = pa.decompress(packed, decompressed_size=m * sum(sizes), codec="zstd", asbytes=True) if m else b""
    at, out = 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, m * size, at).reshape(size, m).T).view(kind).reshape(m))
        at += m * size
    return out


def _ask(block: int, keys: np.ndarray, values: list[np.ndarray], n_shards: int, apart: tuple[float, ...] | None = None, own: list[np.ndarray] | None = None) -> pa.RecordBatch:
    """Sorted keys, cut by shard and kept as steps; empty parts are not sent.

    ``apart`` are totals of what stays in the block; ``own`` are arrays that come back to it with the answers.
    """
    shard = ((keys >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(keys) else np.zeros(0, np.int64)
    spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)][: len(cuts)], strict=True))
    asked = [_pack([np.diff(keys[a:z], prepend=np.uint64(0))]) for a, z in spans]
    packed = [_pack([v[a:z] for v in values]) for a, z in spans]
    shards, m, extra = shard[cuts].tolist(), [z - a for a, z in spans], [None] * len(spans)
    if apart is not None:  # a row without keys, for any shard
        back = -len(own[0]) if own else 0
        shards, m, asked, packed, extra = [*shards, block % n_shards], [*m, back], [*asked, b""], [*packed, _pack(own or [])], [*extra, np.array(apart, np.float64).tobytes()]
    cells = [pa.array(shards, pa.int32()), pa.array(np.full(len(shards), block)), pa.array(m, pa.int32()), *(pa.array(c, pa.binary()) for c in (asked, packed, extra))]
    return pa.RecordBatch.from_arrays(cells, ["shard", "block", "m", "keys", "values", "apart"])


def _exchange(asks: DataFrame, kinds: tuple[str, ...], answer: Callable, name: str) -> tuple[DataFrame, list[float]]:
    """What the shards tell each block, as (block, ``name``), and the totals; ``answer(keys, summed values, number of blocks) -> (arrays, (n, types, ones, twos))``.

    A shard's group has the keys of one hash range from all blocks, summed up by block
    before: no word or pair, however frequent, comes more than once from a block.
    """

    def solve(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        table = table.take(pa.array(np.argsort(table["block"].to_numpy(), kind="stable")))
        lengths = table["m"].to_pylist()  # less than 0: arrays that only pass
        n = [max(m, 0) for m in lengths]
        keys, columns = [], [[] for _ in kinds]
        for asked, packed, m in zip(table["keys"], table["values"], n, strict=True):
            keys.append(np.cumsum(_unpack(asked.as_py(), ("<u8",), m)[0], dtype=np.uint64))
            for to, got in zip(columns, _unpack(packed.as_py(), kinds, m), strict=True):
                to.append(got)
        every, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        sums = [np.bincount(back, np.concatenate(c), len(every)) for c in columns]
        owner = np.zeros(len(back), np.uint8)
        owner[first] = 1
        arrays, totals = answer(every, sums, np.bincount(back, minlength=len(every)))
        totals = sum((np.frombuffer(x) for x in table["apart"].to_pylist() if x), np.array(totals, np.float64))
        told, at = [], 0
        for m, passing, values in zip(n, lengths, table["values"], strict=True):
            own = back[at : at + m]
            told.append(values.as_py() if passing < 0 else _pack([*(a[own] for a in arrays), owner[at : at + m]]))
            at += m
        rows = len(n)
        cells = [table["block"].to_pylist() + [-1], [shard] * (rows + 1), [*lengths, 0], [*told, b""], *([0.0] * rows + [float(t)] for t in totals)]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), *[pa.float64()] * 4]
        return pa.table([pa.array(c, k) for c, k in zip(cells, types, strict=True)], names=["block", "shard", "m", "answer", "n", "types", "ones", "twos"])

    told = asks.groupBy("shard").applyInArrow(solve, _TOLD).groupBy("block")
    sums = [F.sum(c).alias(c) for c in ("n", "types", "ones", "twos")]
    parts = F.sort_array(F.filter(F.collect_list(F.struct("shard", "m", "answer")), lambda x: x["m"] != 0))
    table = bucketed(told.agg(parts.alias(name), *sums), "block", f"lm_{name}")
    totals = table.where("block = -1").select("n", "types", "ones", "twos").first()
    return table.where("block >= 0").select("block", name), [x or 0.0 for x in totals or [0.0] * 4]


def _answers(parts: list[dict] | None, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The answers of all shards in the order asked; the last array marks what this block accounts for."""
    each = [_unpack(p["answer"], kinds, p["m"]) for p in parts or [] if p["m"] > 0]
    return [np.concatenate(c) for c in zip(*each, strict=True)] if each else [np.zeros(0, k) for k in kinds]


def _kept(parts: list[dict] | None, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """What a block has sent to itself."""
    return next((_unpack(p["answer"], kinds, -p["m"]) for p in parts or [] if p["m"] < 0), [np.zeros(0, k) for k in kinds])


# ---- seating --------------------------------------------------------------------


def _uniform(seed: np.ndarray, step: int) -> np.ndarray:
    """Uniform numbers strictly between 0 and 1."""
    return ((mix(seed + np.uint64(step * 0xD1342543DE82EF95 % 2**64)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


@lru_cache(maxsize=4)
def stirling_steps(discount: float, top: int = TABLED) -> np.ndarray:
    """S(c, t) / S(c, t - 1) of the generalised Stirling numbers, by t and c up to ``top``; 0 for t > c.

    From S(c + 1, t) = S(c, t - 1) + (c - t d) S(c, t), divided by that of t - 1.
    """
    out = np.zeros((top + 1, top + 1), np.float32)
    t = np.arange(2, top + 1)
    step = np.zeros(top - 1)  # of t = 2 and more, for one customer
    for c in range(1, top):
        below = np.zeros(top - 1)
        below[1:] = 1 / np.where(step[:-1] > 0, step[:-1], np.inf)
        whole = t <= c + 1
        step = np.where(whole, (1 + (c - t * discount) * step) / np.where(whole, below + c - (t - 1) * discount, 1), 0)
        out[2:, c + 1] = step
    return out


def _tabled(count: np.ndarray, new: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """Draws from new^t S(c, t), 1 <= t <= c <= TABLED, by the inverse of the summed probabilities.

    Of many customers only as many tables are looked at as have weight; the rest have 2e-9 of it at most.
    """
    t, ratio = np.ones(len(count)), new / discount
    wide = np.minimum(count, np.ceil(6 + 1.2 * ratio + 6 * np.sqrt(ratio))).astype(np.int16)
    order = np.argsort(wide, kind="stable")
    ranked = wide[order]
    steps = stirling_steps(discount)
    at = 0
    while at < len(order):
        most = int(ranked[at]) * 9 // 8
        stop = min(int(np.searchsorted(ranked, most, "right")), at + max(1, 200_000 // most))
        own, k = order[at:stop], int(ranked[stop - 1])
        c, total = count[own], np.ones((k, stop - at), np.float32)
        if ratio[own].max() < 80:  # no product of steps overflows
            p, w = np.ones(len(own), np.float32), new[own].astype(np.float32)
            for n in range(2, k + 1):
                p *= w
                p *= steps[n].take(c)
                np.add(total[n - 2], p, out=total[n - 1])
        else:
            with np.errstate(divide="ignore"):
                log_p = np.cumsum(np.vstack([np.zeros(len(own)), np.log(steps[2 : k + 1, c]) + np.log(new[own])]), axis=0)
            total = np.cumsum(np.exp(log_p - log_p.max(0)), axis=0)
        reach, drawn = (u[own] * total[-1]).astype(np.float32), np.ones(len(own), np.int16)
        for so_far in total[:-1]:
            drawn += so_far < reach
        t[own] = drawn
        at = stop
    return t


def _poisson(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Draws of means up to MANY."""
    p = np.exp(-mean)
    reach, k = p.copy(), np.zeros(len(mean))
    for n in range(1, int(MANY + 12 * MANY**0.5)):
        k += u > reach
        p = p * mean / n
        reach += p
    return k


def _normal(count: np.ndarray, ratio: np.ndarray, discount: float, seed: np.ndarray) -> np.ndarray:
    """Draws for many customers and many tables: mean and spread from the saddle point of exp(ratio (1 - (1-x)^d)) / x^c."""

    def at(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full(len(r), -700.0), np.zeros(len(r))
        for _ in range(80):  # y = 1 - x with r d x y^(d-1) = c; the left side falls in y
            mid = (low + high) / 2
            over = np.log(r * discount) + np.log1p(-np.exp(np.minimum(mid, -1e-15))) + (discount - 1) * mid > np.log(count)
            low, high = np.where(over, mid, low), np.where(over, high, mid)
        x = -np.expm1(mid)
        log_spread = np.log(r * discount * x) + (discount - 2) * mid + np.log(np.exp(mid) + (1 - discount) * x)
        return r * -np.expm1(discount * mid), log_spread

    step = 1e-3
    (more, spread_more), (less, spread_less) = at(ratio * np.exp(step)), at(ratio * np.exp(-step))
    mean = (more + less) / 2 - (spread_more - spread_less) / (4 * step)
    deviation = np.sqrt(np.maximum((more - less) / (2 * step), 0))
    z = np.sqrt(-2 * np.log(_uniform(seed, 2))) * np.cos(2 * np.pi * _uniform(seed, 3))
    return np.clip(np.round(mean + deviation * z), 1, count)


def draw_tables(count: np.ndarray, new: np.ndarray, discount: float, seed: np.ndarray) -> np.ndarray:
    """Number of tables of dishes with ``count`` customers, drawn given the weight ``new`` of a new table.

    Up to TABLED customers the draw is exact.  Beyond, tables of the first TABLED stay with
    a weight that falls as (TABLED / c)^discount for each of them, and new ones come as a
    Poisson number, the limit for c far above t; where many tables are expected, by a
    normal law.  One customer always has one table, none has none.
    """
    out = np.minimum(count, 1).astype(np.float64)
    at = np.flatnonzero(count > 1)
    if not len(at):
        return out
    c, w, own = count[at].astype(np.int64), np.maximum(new[at], 1e-300), seed[at]
    ratio, long_ = w / discount, c > TABLED
    t, few = np.empty(len(at)), ~long_ | (ratio <= MANY)
    shrink = np.where(long_, (TABLED / c) ** discount, 1.0)
    t[few] = _tabled(np.minimum(c, TABLED)[few], (w * shrink)[few], discount, _uniform(own, 0)[few])
    grown = few & long_
    t[grown] += _poisson((ratio * (1 - shrink))[grown], _uniform(own, 1)[grown])
    t[~few] = _normal(c[~few].astype(np.float64), ratio[~few], discount, own[~few])
    out[at] = t
    return out


# ---- the model ------------------------------------------------------------------


def _discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones + twos else 0.5


@dataclass
class Model:
    """What all blocks know: counts of tokens, types, documents and blocks, discounts, and customers and tables of the unigram restaurant by round."""

    n_train: float
    n_types: float
    n_docs: float
    n_blocks: int
    d1: float
    d2: float
    totals: list[tuple[float, float]]

    def at_top(self, by_w: np.ndarray, names: np.ndarray, turn: int) -> np.ndarray:
        """Tables of the unigram restaurant, given how many it had in the round before."""
        if not turn:
            return np.minimum(by_w, 1).astype(np.float64)
        new = (STRENGTH + self.d1 * self.totals[turn - 1][1]) / (self.n_types + 1)
        return draw_tables(by_w.astype(np.int64), np.full(len(by_w), new), self.d1, mix(names + np.uint64(turn)))


class Seated:
    """A block with its counts; by round the tables by context and by word, those of the unigram restaurant and the pairs' draws."""

    def __init__(self, row: dict, model: Model):
        self.row, self.b, self.model = row, Block(row).paired(), model
        b = self.b
        self.c, shared, _ = _answers(row["words"], WORD_KINDS)
        at = b.open_pairs(self.c, shared, model.n_docs, model.n_blocks)
        self.count, mine = b.local.astype(np.int64), b.local > 0
        told, owner = _answers(row["pairs"], PAIR_KINDS)
        self.count[at], mine[at] = told, owner.astype(bool)
        self.mine = mine & (self.count > 0)
        self.c_u = np.append(self.c, model.n_docs)[b.u]
        self.v = len(b.vocabulary)
        self.sent = _sent(b, shared)
        self.own = np.setdiff1d(np.arange(self.v), self.sent, assume_unique=True)  # all tables of these words are this block's

    def tables(self, turn: int) -> list[np.ndarray]:
        """Tables by context and by word, and the unigram restaurant's, after a round that was exchanged."""
        out = [np.zeros(self.v + 1) for _ in range(3)]
        parts = self.row[f"tables{turn}"]
        for to, got, kept in zip(out, _answers(parts, TABLE_KINDS)[:3], _kept(parts, TABLE_KINDS[:3]), strict=True):
            to[self.sent], to[self.own] = got, kept
        return out

    def prior(self, turn: int) -> np.ndarray:
        """The parent's share of each pair, times the strength that its restaurant gives it, after a round."""
        by_u, by_w, top = self.tables(turn)
        m = self.model
        customers1, tables1 = m.totals[turn]
        unigram = (by_w[: self.v] - m.d1 * top[: self.v] + (STRENGTH + m.d1 * tables1) / (m.n_types + 1)) / (STRENGTH + customers1)
        return (STRENGTH + m.d2 * by_u[self.b.u]) * unigram[self.b.w]

    def draw(self, turn: int) -> np.ndarray:
        """Tables of each pair, given all others after the round before; at first each dish has one."""
        if not turn:
            return np.minimum(self.count, 1).astype(np.float64)
        return draw_tables(self.count, self.prior(turn - 1), self.model.d2, mix(self.b.pair_hash + np.uint64(turn)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
            pa.default_memory_pool().release_unused()


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Documents whose crc32 of the id as text is 2 modulo 7 are held out, all others
    train the model.  A null text is empty and has one token, its end; a null id is
    hashed as the empty text.  Repeated rows count each time.  Without any training
    document both scores are those of a vocabulary of one unknown word.
    """
    spark = docs.sparkSession
    T = blocks(docs)
    asked = T.agg(F.count("*"), F.sum(F.length("vocabulary") / 8), F.sum(F.length("tokens") / 4)).first()
    n_blocks = asked[0]
    n_shards = max(partitions(spark), -(-int(asked[2] or 0) // SHARD_KEYS))

    def ask_words(batches):
        for row in _rows(batches):
            b = Block(row)
            count = np.bincount(b.tokens[b.train], minlength=len(b.vocabulary)).astype(np.int32)
            yield _ask(b.id, b.vocabulary, [count], n_shards)

    def add_counts(keys, sums, n):
        c = sums[0].astype(np.int64)
        return [c], (c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum())

    def add_words(keys, sums, n):
        (c,), totals = add_counts(keys, sums, n)
        return [c, (n > 1).astype(np.uint8)], totals

    words, (n_train, n_types, ones1, twos1) = _exchange(T.mapInArrow(ask_words, _ASK), ("<i4",), add_words, "words")
    with_words = T.join(words, "block", "left")

    # the end's count is the number of training documents, and so of starts
    ends = T.select("held").mapInArrow(_count_held, "n long").agg(F.sum("n")).first()[0] or 0

    def ask_pairs(batches):
        for row in _rows(batches):
            b = Block(row).paired()
            c, shared, _ = _answers(row["words"], WORD_KINDS)
            at = b.open_pairs(c, shared, ends, n_blocks)
            kept = b.local.copy()
            kept[at] = 0
            apart = (kept.sum(), (kept > 0).sum(), (kept == 1).sum(), (kept == 2).sum())
            yield _ask(b.id, b.pair_hash[at], [b.local[at].astype(np.int32)], n_shards, apart)

    pairs, (_, _, ones2, twos2) = _exchange(with_words.mapInArrow(ask_pairs, _ASK), ("<i4",), add_counts, "pairs")
    with_pairs = with_words.join(pairs, "block", "left")

    model = Model(n_train, n_types, ends, n_blocks, _discount(ones1, twos1), _discount(ones2, twos2), [])
    rounds: list[DataFrame] = []
    for turn in range(ROUNDS):

        def ask_tables(batches, turn=turn):
            for row in _rows(batches):
                s = Seated(row, model)
                b, t = s.b, s.draw(turn)
                by_u, by_w = (np.bincount(x[s.mine], t[s.mine], s.v + 1) for x in (b.u, b.w))
                top = model.at_top(by_w[s.own], b.vocabulary[s.own], turn)
                own = [x.astype(np.int64) for x in (by_u[s.own], by_w[s.own], top)]
                yield _ask(b.id, _names(b)[s.sent], [x[s.sent].astype(np.int64) for x in (by_u, by_w)], n_shards, (own[1].sum(), own[2].sum(), 0, 0), own)

        def add_tables(keys, sums, n, turn=turn):
            by_u, by_w = sums
            top = model.at_top(by_w, keys, turn)
            return [x.astype(np.int64) for x in (by_u, by_w, top)], (by_w.sum(), top.sum(), 0, 0)

        before = with_pairs.join(rounds[-1], "block", "left") if rounds else with_pairs
        tables, (customers1, tables1, _, _) = _exchange(before.mapInArrow(ask_tables, _ASK), ("<i8", "<i8"), add_tables, f"tables{turn}")
        model.totals.append((customers1, tables1))
        rounds.append(tables)

    def score(batches):
        for row in _rows(batches):
            s = Seated(row, model)
            b, c = s.b, s.c
            p = np.mean([(s.count - model.d2 * s.draw(turn) + s.prior(turn)) / (STRENGTH + s.c_u) for turn in range(1, ROUNDS)], axis=0)
            base = np.log10((c + 1) / (n_train + n_types + 1))
            n = len(b.lengths)
            add = lambda x: np.bincount(b.doc, x, n)
            cells = [b.doc_ids, b.held, b.lengths, add((c > 0)[b.tokens]).astype(np.int64), np.full(n, int(n_train)), add(base[b.tokens]), add(np.log10(p)[b.pair_of])]
            ids = pa.array(b.doc_ids, mask=b.doc_ids == -(2**63))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, cells[1:])], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    with_tables = reduce(lambda a, t: a.join(t, "block", "left"), rounds, with_pairs)
    return with_tables.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _names(b: Block) -> np.ndarray:
    """The vocabulary and, no word but a context, the start."""
    return np.append(b.vocabulary, START)


def _sent(b: Block, shared: np.ndarray) -> np.ndarray:
    """Places of the words that other blocks have too, and of the start, by hash; all tables of other words are this block's."""
    at = np.append(np.flatnonzero(shared), len(b.vocabulary))
    return at[np.argsort(_names(b)[at])]


def _count_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = sum(int((np.frombuffer(x.as_py(), np.uint8) == 0).sum()) for x in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])
