"""Best-fit packing of token sequences by linear grouping.

Tokens are counted once, in parallel.  Planning needs only how many pieces there
are of each length, 1 to the capacity: at most 1024 numbers, whatever the corpus.
Large lengths are put in groups of equal cardinality and rounded up to the largest
of the group; configurations of those few sizes are chosen by a knapsack; actual
lengths replace the rounded ones; short pieces then go where they fit best.  The
plan says, for runs of the ranks of each length, which sequence and offset they
get; pieces look their place up by rank, in parallel.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm.store import partitions, written

CAPACITY, END_ID = 1024, 2
#: Shares of the capacity above which a length counts as large, and numbers of groups; each pair is planned, the shortest plan is taken.
LARGE, GROUPS = (1 / 16, 1 / 6, 1 / 3), (16, 40, 120, 400)
#: Words whose ids a worker remembers.
REMEMBERED = 400_000
# Fixed value: how the byte-level BPE vocabulary splits a text into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Texts with other characters than these, or with a special token, are encoded whole: regular expression engines class them differently.
SURE = "[^\t-\r -~À-ÖØ-öø-ſ‘-”–—…€¡¿«»]"


@lru_cache(maxsize=2)
def _encoder(path: str | None):
    """text -> ids as little-endian bytes; the same ids as the tokenizer file gives.

    Words are encoded apart and the first REMEMBERED of them are kept.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    # the file's ids are the order of its merges, so they serve as merge ranks
    # byte-level files write visible bytes as themselves, the others as the code points from 256 on
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(visible)))}
    special = {t.content for t in whole.get_added_tokens_decoder().values()}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in whole.get_vocab().items() if token not in special}
    merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    split, unsure = re.compile(SPLIT).findall, re.compile("|".join([SURE, *map(re.escape, sorted(special))])).search
    known: dict[str, bytes] = {}

    def one(word: str) -> bytes:
        ids = merge(word.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(known) < REMEMBERED:
            known[word] = packed
        return packed

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if unsure(text):
            ids = whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        get = known.get
        return b"".join([get(w) or one(w) for w in split(text)])

    return encode


def cut(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document's ids; only the first may be short."""
    n = len(ids) // 4
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document.

    Null texts count as empty: one piece that holds only the end id.  Repeated rows
    give repeated pieces; other columns are ignored.
    """
    end = struct.pack("<I", end_id)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                rows = []
                for doc, text in zip(batch.column(0)[k : k + 500].to_pylist(), batch.column(1)[k : k + 500], strict=True):
                    ids = encode(text.as_py() or "") + end
                    for i, (s, n) in enumerate(cut(ids, capacity)):
                        part = ids[4 * s : 4 * (s + n)]
                        rows.append((doc, i, s, n, zlib.crc32(part)) + ((part,) if with_ids else ()))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


# ---- planning, on counts of lengths only --------------------------------------


def _groups(large: dict[int, int], n_groups: int) -> list[tuple[int, list[list[int]]]]:
    """(rounded size, [[length, count], ...] longest first) of groups of equal cardinality."""
    total = sum(large.values())
    each, out, room = -(-total // n_groups), [], 0
    for length in sorted(large, reverse=True):
        n = large[length]
        while n:
            if not room:
                out.append((length, []))
                room = each
            take = min(n, room)
            out[-1][1].append([length, take])
            n, room = n - take, room - take
    return out


def _configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size fill a sequence best, the largest that is left among them."""
    first = next(g for g, n in enumerate(left) if n)
    used = [0] * len(sizes)
    used[first] = 1
    room = capacity - sizes[first]
    best = np.full(room + 1, -1, np.int32)  # the size put last to reach a sum; -2 for nothing yet
    reach = np.zeros(room + 1, bool)
    reach[0], best[0] = True, -2
    count = np.zeros((len(sizes), room + 1), np.int16)
    for g, s in enumerate(sizes):
        have = left[g] - (g == first)
        if have <= 0 or s > room:
            continue
        for t in range(s, room + 1):
            if not reach[t] and reach[t - s] and count[g, t - s] < have:
                reach[t], best[t], count[g, t] = True, g, count[g, t - s] + 1
        if reach[room]:
            break
    t = int(np.flatnonzero(reach)[-1])
    while t:
        used[best[t]] += 1
        t -= sizes[best[t]]
    return used


def plan_once(counts: dict[int, int], capacity: int, large_share: float, n_groups: int) -> list[tuple[int, tuple[int, ...]]]:
    """[(number of sequences, lengths in each)]."""
    bins: Counter[tuple[int, ...]] = Counter()
    large = {n: c for n, c in counts.items() if n > capacity * large_share and n < capacity}
    if counts.get(capacity):
        bins[(capacity,)] = counts[capacity]
    groups = _groups(large, n_groups)
    sizes, left = [g[0] for g in groups], [sum(c for _, c in g[1]) for g in groups]
    while any(left):
        used = _configuration(sizes, left, capacity)
        times = min(left[g] // u for g, u in enumerate(used) if u)
        slots = [g for g, u in enumerate(used) for _ in range(u)]
        # actual lengths take the slots, longest first, as many at once as all slots have of one
        done, need = 0, Counter(slots)
        while done < times:
            take = min([times - done, *(groups[g][1][0][1] // u for g, u in need.items() if groups[g][1][0][1] >= u)])
            take = 1 if any(groups[g][1][0][1] < u for g, u in need.items()) else take
            lengths = [n for g, u in need.items() for n in _take(groups[g][1], u, take)]
            bins[tuple(sorted(lengths, reverse=True))] += take
            done += take
        for g, u in enumerate(used):
            left[g] -= u * times
    _best_fit(bins, {n: c for n, c in counts.items() if n <= capacity * large_share}, capacity)
    return [(c, b) for b, c in sorted(bins.items(), reverse=True) if c]


def _take(stock: list[list[int]], u: int, times: int) -> list[int]:
    """The next u lengths of a group's stock, each taken ``times`` times."""
    out: list[int] = []
    while len(out) < u:
        n = min(u - len(out), stock[0][1] // times)
        out += [stock[0][0]] * n
        stock[0][1] -= n * times
        if not stock[0][1]:
            del stock[0]
    return out


def _best_fit(bins: Counter, small: dict[int, int], capacity: int) -> None:
    """Puts short pieces, longest first, where the least room stays."""
    by_room: dict[int, Counter] = {}
    for b, c in bins.items():
        by_room.setdefault(capacity - sum(b), Counter())[b] += c
    for length in sorted(small, reverse=True):
        n = small[length]
        for room in [r for r in sorted(by_room) if r >= length]:
            fit = room // length
            while n and by_room[room]:
                b, c = by_room[room].popitem()
                each = min(fit, n)
                take = min(c, n // each)
                if c > take:
                    by_room[room][b] += c - take
                by_room.setdefault(room - each * length, Counter())[(*b, *[length] * each)] += take
                n -= take * each
            if not n:
                break
        if n:
            fit = capacity // length
            for times, each in ((n // fit, fit), (1, n % fit)):
                if times and each:
                    by_room.setdefault(capacity - each * length, Counter())[(length,) * each] += times
    bins.clear()
    for of in by_room.values():
        bins.update(of)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """The shortest of the plans for a few thresholds and numbers of groups."""
    floor = -(-sum(n * c for n, c in counts.items()) // capacity)
    best = None
    for share in LARGE:
        for n_groups in GROUPS:
            now = plan_once(counts, capacity, share, n_groups)
            if best is None or sum(c for c, _ in now) < sum(c for c, _ in best):
                best = now
            if sum(c for c, _ in best) <= floor:
                return best
    return best or []


def places(made: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset), by rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter[int] = Counter()
    sequence = 0
    for times, lengths in made:
        offset = 0
        for n in lengths:
            out.setdefault(n, []).append((used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def pack(cut_up: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut_up`` (doc_id, piece, length, ...) with ``sequence_id`` and ``offset``.

    Pieces of one length are ranked over the whole table without bringing them
    together: by a row number within each of many hashed parts, and the parts' sums.
    An empty table gives an empty result.
    """
    spark = cut_up.sparkSession
    cut_up = cut_up.withColumn("__part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(partitions(spark) * 4)))
    sums = cut_up.groupBy("length", "__part").agg(F.count("*").alias("__n"))
    counts = {r[0]: r[1] for r in sums.groupBy("length").agg(F.sum("__n")).collect()}  # one row for each length, capacity at most
    table = places(plan(counts, capacity))
    before = sums.select("length", "__part", (F.sum("__n").over(Window.partitionBy("length").orderBy("__part")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("length", "__part").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cut_up.withColumn("__rank", within - 1).join(before, ["length", "__part"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    columns = [c for c in cut_up.columns if c != "__part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("__rank")).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                rows = table[int(n)]
                at = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                sequence[own] = at[:, 1] + rank[own] - at[:, 0]
                offset[own] = at[:, 2]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = cut_up.select(columns).withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    return ranked.select(*columns, "__rank").mapInArrow(run, schema)


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and offset; tokens are counted once and kept in a written table."""
    return pack(written(pieces(docs, path, capacity, with_ids=with_ids), "pieces"), capacity)
