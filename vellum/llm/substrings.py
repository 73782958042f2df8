"""Removal of passages that a document with a smaller id has too.

A word goes if a window of 50 consecutive words covers it whose word sequence also
starts in a document with a smaller doc_id.

1. Anchors: of the 43 eight-word runs in a window the one with the least hash is
   its anchor, so equal windows have equal anchors.  Consecutive windows with one
   anchor form a segment.  One row for each segment, about one for 20 words.
2. Segments are summed up by anchor and content before anything meets; anchors of one
   document go.  Of equal segments one is read, of the first document that has it: it
   stands for that document and, if there are more, for all later ones.
3. Anchors are dealt over reference shards.  In each the segments stream by, in the order
   of doc_id, through a suffix automaton of those with smaller ids; its matching
   statistics say which windows have been seen, for the first document before its own
   segment enters the automaton and for the later ones after.  The reference is the
   corpus itself and grows, so shards are dealt by anchor rather than broadcast whole.
4. Covered spans are collected by document and cut from the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.store import partitions, unused, written
from vellum.llm.words import Words, iter_slices, mix

SPAN, RUN = 50, 8
#: Contents of one anchor beyond which its segments are dealt by a second anchor as well.
CROWDED = 2_000
#: Document ids with text hashes, 16 bytes each and some 20 MB as a table, up to which a list of them is broadcast; beyond, the join is shuffled.
BROADCAST_IDS = 200_000
#: Words that a shard reads before it matches those of complete anchors.
SHARD_WORDS = 500_000
_K = np.uint64(0x9E3779B97F4A7C15)


def _prefix(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and powers with which any run of word hashes gets a hash of its own."""
    powers = np.full(len(h) + 1, _K, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    total = np.zeros(len(h) + 1, np.uint64)
    # sum of h[i] * K^(n-i): a run's share is brought to one scale by the power of its end
    np.cumsum(h * powers[len(h) - 1 :: -1] if len(h) else h, out=total[1:])
    return total, powers


_INVERSE = np.uint64(pow(int(_K), -1, 2**64))


def run_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the runs h[first:last], the same for equal runs wherever they stand."""
    total, _ = _prefix(h)
    back = np.full(len(h) + 1, _INVERSE, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    return mix((total[last] - total[first]) * back[len(h) - last] + (last - first).astype(np.uint64) * _K)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys."""
    have, out = 1, keys
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(keys) - width + 1], out[width - have :]) if have < width else out


def anchors(h: np.ndarray, banned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each window of SPAN words: the place and the hash of its anchor. ``banned`` places of runs can't be one."""
    runs = run_hashes(h, np.arange(len(h) - RUN + 1), np.arange(RUN, len(h) + 1))
    bits = np.uint64(max(1, int(len(runs)).bit_length()))
    keys = (runs >> bits << bits) | np.arange(len(runs), dtype=np.uint64)
    if banned is not None:
        keys = keys.copy()
        keys[banned] |= ~np.uint64(0) >> bits << bits
    at = (_least(keys, SPAN - RUN + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return at, runs[at]


def segments_of(w: Words) -> tuple[np.ndarray, ...]:
    """(document, anchor, content, first window, last window) of each segment; windows count from the document's start."""
    h = w.hashes
    none = np.zeros(0, np.int64)
    if len(h) < SPAN:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    at, key = anchors(h)
    doc = w.doc_of_word()
    good = doc[: len(at)] == doc[SPAN - 1 :]
    start = np.flatnonzero(good)
    if not len(start):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    new = np.r_[True, (start[1:] != start[:-1] + 1) | (at[start[1:]] != at[start[:-1]]) | (doc[start[1:]] != doc[start[:-1]])]
    first = start[new]
    last = start[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]]
    content = run_hashes(h, first, last + SPAN)
    own = doc[first]
    base = w.offsets[own]
    return own, key[first], content, first - base, last - base


def segments(docs: DataFrame) -> DataFrame:
    """(anchor, content, doc_id, text_hash, s0, s1) of every document of SPAN words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for w in iter_slices(batch.column(2), lower=False):
                own, key, content, first, last = segments_of(w)
                rows = own + w.first_row
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[rows]), pa.array(hashes[rows]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["anchor", "content", "doc_id", "text_hash", "s0", "s1"])

    return docs.mapInArrow(run, "anchor long, content long, doc_id long, text_hash long, s0 int, s1 int")


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]

    def add(self, seq) -> None:
        last = 0
        nxt, link, length = self.next, self.link, self.len
        for c in seq:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, c, q)
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = cur

    def _clone(self, p: int, c, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def matching(self, seq) -> list[int]:
        """For each place, the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.len
        state, n, out = 0, 0, []
        for c in seq:
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                n += 1
            out.append(n)
        return out


def _excerpts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The words (as hashes) of the asked segments: (key, anchor, content, doc_id, base, again, words).

    A crowded anchor's segment is cut where the second least run of its windows
    changes, and dealt by both; equal windows still meet.
    """
    lists = asked.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "content", "s0", "s1", "crowded", "again")).alias("asked"))
    lists = written(lists, "lists")
    ids = lists.select("doc_id", "text_hash")
    texts = docs.join(_if_few(ids), ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column(0).to_pylist(), batch.column(2)
            for w in iter_slices(batch.column(1), lower=False):
                h = w.hashes
                rows = []
                for i in range(w.n_docs):
                    r = w.first_row + i
                    for a in wanted[r].as_py():
                        own = h[w.offsets[i] + a["s0"] : w.offsets[i] + a["s1"] + SPAN]
                        if not a["crowded"]:
                            rows.append((a["anchor"], a["anchor"], a["content"], ids[r], 0, a["again"], own.tobytes()))
                            continue
                        at, _ = anchors(own)
                        second, key = anchors(own, banned=np.unique(at))
                        cuts = [0, *(np.flatnonzero(second[1:] != second[:-1]) + 1).tolist(), len(second)]
                        for x, y in zip(cuts, cuts[1:], strict=False):
                            both = int(mix(key[x : x + 1] ^ np.uint64(a["anchor"] & (2**64 - 1))).view(np.int64)[0])
                            rows.append((both, a["anchor"], a["content"], ids[r], x, a["again"], own[x : y + SPAN - 1].tobytes()))
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.int32(), pa.bool_(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "anchor", "content", "doc_id", "base", "again", "words"])

    joined = texts.join(lists, ["doc_id", "text_hash"]).select("doc_id", "text", "asked")
    return joined.mapInArrow(run, "key long, anchor long, content long, doc_id long, base int, again boolean, words binary")


def _matcher(filtered: bool):
    """The matching of a shard. ``filtered`` keeps windows that no other row of the shard has, by hash, out of the automata; they can't be found, so results are the same."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans of each segment that a smaller document has, for its first document and for later ones; rows come by key and doc_id."""
        names = ["anchor", "content", "later", "a", "z"]
        held: list[tuple] = []
        n_words = 0

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            seqs = [np.frombuffer(r[6], np.uint64) for r in rows]
            flat = np.concatenate(seqs)
            row_of = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
            start = np.flatnonzero(row_of[: len(flat) - SPAN + 1] == row_of[SPAN - 1 :])
            if filtered:
                keys = np.array([r[0] for r in rows], np.int64).view(np.uint64)
                whole = mix(run_hashes(flat, start, start + SPAN) ^ mix(keys[row_of[start]]))
                order = np.argsort(whole, kind="stable")
                twin = np.zeros(len(order), bool)
                twin[1:] = whole[order[1:]] == whole[order[:-1]]
                twin[:-1] |= twin[1:]
                twin |= np.array([r[5] for r in rows], bool)[row_of[start[order]]]
                start = np.sort(start[order[twin]])
            out: list[tuple[int, int, bool, int, int]] = []
            cut = np.flatnonzero(np.r_[True, (start[1:] != start[:-1] + 1) | (row_of[start[1:]] != row_of[start[:-1]])]) if len(start) else []
            first = np.concatenate(([0], np.cumsum([len(s) for s in seqs])))
            runs = [(int(row_of[start[i]]), int(start[i]), int(start[j - 1]) + SPAN) for i, j in zip(cut, [*cut[1:], len(start)], strict=True)]
            known, key, doc, entering, later = SuffixAutomaton(), None, None, [], []

            def told(r: int, at: int, seq: list[int], after: bool) -> int:
                seen = [i for i, n in enumerate(known.matching(seq)) if n >= SPAN]
                base = at - int(first[r]) + rows[r][4] - SPAN + 1
                for i in seen:
                    lo, hi = base + i, base + i + SPAN
                    if out and out[-1][:3] == (rows[r][1], rows[r][2], after) and out[-1][3] <= lo <= out[-1][4]:
                        out[-1] = (*out[-1][:4], hi)
                    else:
                        out.append((rows[r][1], rows[r][2], after, lo, hi))
                return len(seen)

            def enter() -> None:
                """The document's segments enter the automaton; then its copies in later documents are looked up."""
                for seq in entering:
                    known.add(seq)
                for x in later:
                    told(*x, True)
                entering.clear()
                later.clear()

            for r, a, z in runs:
                if rows[r][0] != key or rows[r][3] != doc:
                    enter()
                    if rows[r][0] != key:
                        known = SuffixAutomaton()
                    key, doc = rows[r][0], rows[r][3]
                seq = flat[a:z].tolist()
                if told(r, a, seq, False) < len(seq) - SPAN + 1:
                    entering.append(seq)
                if rows[r][5]:
                    later.append((r, a, seq))
            enter()
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n_words >= SHARD_WORDS and held[-1][0] != row[0]:
                    yield solve(held)
                    held, n_words = [], 0
                held.append(row)
                n_words += len(row[6]) // 8
        if held:
            yield solve(held)

    return match


def _if_few(ids: DataFrame) -> DataFrame:
    """``ids`` to be broadcast if they are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def covered(docs: DataFrame, filtered: bool = True) -> DataFrame:
    """(doc_id, text_hash, spans): the word spans [a, z) that go, for documents that lose words."""
    segs = written(segments(docs.select("doc_id", "text_hash", "text")), "segments")
    first = F.struct("doc_id", "text_hash", "s0", "s1")
    each = segs.groupBy("anchor", "content").agg(F.min(first).alias("first"), F.max("doc_id").alias("last"))
    each = written(each, "contents")
    shared = each.groupBy("anchor").agg(F.count("*").alias("n"), F.min("first.doc_id").alias("lo"), F.max("last").alias("hi")).where("lo < hi")
    each = written(each.join(shared.select("anchor", "n"), "anchor").select("anchor", "content", "first.*", "last", "n"), "shared")
    asked = each.withColumns({"crowded": F.col("n") > CROWDED, "again": F.col("last") > F.col("doc_id")})
    excerpts = _excerpts(docs, asked).repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key", "doc_id")
    matched = excerpts.mapInArrow(_matcher(filtered), "anchor long, content long, later boolean, a int, z int")
    spans = lambda later: F.collect_list(F.when(F.col("later") == later, F.struct("a", "z")))
    matched = matched.groupBy("anchor", "content").agg(spans(False).alias("own"), spans(True).alias("later"))
    told = each.select("anchor", "content", F.col("doc_id").alias("owner")).join(matched, ["anchor", "content"])
    told = written(told, "told")  # so that both sides of the join are dealt anew, and a passage that very many documents share can be split
    both = segs.join(told, ["anchor", "content"])
    found = F.when(F.col("doc_id") > F.col("owner"), F.col("later")).otherwise(F.col("own"))
    placed = F.transform(found, lambda s: F.struct((s["a"] + F.col("s0")).alias("a"), (s["z"] + F.col("s0")).alias("z")))
    return both.select("doc_id", "text_hash", placed.alias("spans")).where("size(spans) > 0").groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _removed(words: list[bytes], spans: list[dict] | None) -> list[bytes]:
    if not spans:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, [s["a"] for s in spans], 1)
    np.add.at(gone, [s["z"] for s in spans], -1)
    return [w for w, n in zip(words, np.cumsum(gone).tolist(), strict=False) if not n]


def without_repeats(docs: DataFrame, filtered: bool = True) -> DataFrame:
    """``docs`` with the text that is left and n_words, n_removed, kept_sha256.

    A text that loses words becomes its other words joined by one space; others
    stay as they are, null included.  kept_sha256 is that of the joined words either
    way.  Rows with a null doc_id keep all words and take none from others; rows with
    one doc_id count as one document.  Own columns of those names are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    own_hash, own_id, other_hash, lost_at = unused(docs, "own_hash", "own_id", "other_hash", "lost_at")
    keyed = docs.withColumn(own_hash, F.xxhash64("text"))
    thin = keyed.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col(own_hash).alias("text_hash"), "text")
    spans = written(covered(thin, filtered), "spans").select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(other_hash), F.col("spans").alias(lost_at))
    ids = _if_few(spans.select(own_id, other_hash))
    on = (F.col("doc_id").cast("long") == F.col(own_id)) & (F.col(own_hash) == F.col(other_hash))
    columns, quoted = docs.columns, [f"`{c}`" for c in docs.columns]
    cut = keyed.join(ids, on, "left_semi").join(spans, on).select(*quoted, lost_at)
    rest = keyed.join(ids, on, "left_anti").select(*quoted, F.lit(None).cast(cut.schema[lost_at].dataType).alias(lost_at))
    every = cut.unionByName(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts, lost, out = part.column(part.schema.get_field_index("text")), part.column(part.num_columns - 1), []
                for text, spans in zip(texts, lost, strict=True):
                    text = text.as_py()
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    kept = _removed(words, spans.as_py())
                    joined = b" ".join(kept)
                    out.append((text if len(kept) == len(words) else joined.decode("utf-8", "surrogatepass"), len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest()))
                new = dict(zip(("text", "n_words", "n_removed", "kept_sha256"), zip(*out, strict=True), strict=True))
                own = [pa.array(new["text"], pa.string()) if c == "text" else part.column(part.schema.get_field_index(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array(new["n_words"], pa.int64()), pa.array(new["n_removed"], pa.int64()), pa.array(new["kept_sha256"], pa.string())], [*columns, "n_words", "n_removed", "kept_sha256"])

    extra = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    return every.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))
