"""Token counts by a tokenizer compiled to a deterministic transducer.

The tokenizer file (lower-casing, a splitting pattern, byte pair merges whose last
symbol carries an end mark) becomes one machine over bytes tagged with the class of
their character.  A state knows the kind of the open word and, for every place where
a token that is still open could have begun, the last token before it and how many
tokens fewer that prefix had.  A transition is annotated with the number of tokens
that it adds (negative where tokens melt together); closing a word adds the rest.
States and transitions are compiled when they are first met, so only those that texts
need exist; a table that has grown beyond its bound is thrown away and begun anew.

A text is cut into chunks, behind white space wherever there is some, and all chunks
of many texts take their steps side by side as rows of one numpy table look-up.  A
chunk's state map holds entry state -> (exit state, tokens) for the states that can
arrive: the start state behind white space; in a run without any, a state guessed from
the symbols before the cut, and then whatever exits the chunk before really has.  The
maps of a text are composed by a parallel prefix scan (pointer doubling).
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
#: Symbols of a chunk, symbols before a cut that its entry state is guessed from, and symbols of texts that step together.
CHUNK, GUESS, TOGETHER = 1024, 48, 1 << 20
#: Cells of the transition table (4 bytes each, taken from memory as they are used), pairs of tokens remembered, and the share of states in use at which the machine is begun anew.
MAX_CELLS, MAX_AGREES, WORN = 1 << 25, 1 << 18, 0.75
NEVER = 1 << 30
END = "</w>"
START = ("", 0)
SPACE, APOSTROPHE = "space", 0x27
#: What can follow an apostrophe at the start of a word: one letter, or two.
ONE, TWO = b"stmd", {0x72: 0x65, 0x76: 0x65, 0x6C: 0x6C}


class Full(Exception):
    """The machine has outgrown its bound."""


class Merges:
    """The byte pair machine of single words: states, steps and closings, found when first asked for."""

    def __init__(self, model: dict):
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(visible)))}
        self.char, self.byte = [char[b] for b in range(256)], [bytes([b]) for b in range(256)]
        spelt = {c: (bytes([b]), False) for b, c in char.items()} | {c + END: (bytes([b]), True) for b, c in char.items()}
        self.rank: dict[tuple[str, str], int] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((a, b), k)
            spelt.setdefault(a + b, (spelt[a][0] + spelt[b][0], spelt[b][1]))
        self.spelt = spelt
        self.inner = {s: t for t, (s, end) in spelt.items() if not end}
        self.last = {s: t for t, (s, end) in spelt.items() if end}
        self.begun = {s[:k] for s in self.inner for k in range(1, len(s))} | {s[:k] for s in self.last for k in range(1, len(s) + 1)}
        self.agrees: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Only the state of an empty word is left."""
        # a state: the open bytes, then for each place (bytes before its end, token before it, tokens fewer), the end itself first
        self.states: list[tuple] = [(b"", 0, "", 0)]
        self.number = {self.states[0]: 0}
        self.closes: dict[int, int] = {}
        if len(self.agrees) > MAX_AGREES:
            self.agrees = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """``symbols`` after all merges, the least rank first, of equal ones the leftmost."""
        rank = self.rank.get
        while len(symbols) > 1:
            ranks = [rank(pair, NEVER) for pair in zip(symbols, symbols[1:])]
            least = min(ranks)
            if least == NEVER:
                break
            k = ranks.index(least)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols

    def fits(self, before: str, token: str) -> bool:
        """Whether ``token`` can follow ``before`` (empty: begin a word), that is, merging both anew gives both again."""
        known = self.agrees.get((before, token))
        if known is None:
            symbols = [self.char[b] for b in (self.spelt[before][0] if before else b"") + self.spelt[token][0]]
            if self.spelt[token][1]:
                symbols[-1] += END
            known = self.agrees[before, token] = self.merged(symbols) == [t for t in (before, token) if t]
        return known

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """(state after one more byte, tokens added)."""
        known = self.states[state]
        text, places = known[0] + self.byte[byte], dict(zip(known[1::3], zip(known[2::3], known[3::3])))
        size = len(text)
        for k in range(size):
            token = self.inner.get(text[k:])
            if token is not None:
                before, fewer = places[size - k - 1]
                if self.fits(before, token):
                    break
        else:
            raise ValueError("a vocabulary whose merges don't determine the last token")
        added = fewer + 1
        new = [b"", 0, token, 0]
        for k in range(size):
            if text[k:] in self.begun:
                before, fewer = places[size - k - 1]
                new[0] = new[0] or text[k:]
                new += (size - k, before, fewer - added)
        key = tuple(new)
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.states)
            self.states.append(key)
        return at, added

    def close(self, state: int) -> int:
        """Tokens that the end of the word adds."""
        known = self.closes.get(state)
        if known is None:
            text, *places = self.states[state]
            ways = ((before, fewer, self.last.get(text[len(text) - size :])) for size, before, fewer in zip(places[::3], places[1::3], places[2::3]) if size)
            known = self.closes[state] = next(fewer + 1 for before, fewer, token in ways if token is not None and self.fits(before, token))
        return known

    def of_word(self, word: bytes) -> int:
        state = n = 0
        for b in word:
            state, added = self.step(state, b)
            n += added
        return n + self.close(state)


class Transducer:
    """The whole tokenizer: kinds of words around the byte pair machine, as a table."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers

        file = Tokenizer.from_file(path)
        with open(path) as f:
            self.merges = Merges(json.load(f)["model"])
        self.normalize, self.split, self.compose = file.normalizer.normalize_str, file.pre_tokenizer.pre_tokenize_str, normalizers.NFC().normalize_str
        self.special = re.compile("|".join(sorted((re.escape(t.content) for t in file.get_added_tokens_decoder().values()), key=len, reverse=True)))
        self.symbols = {(SPACE, 0): 0}
        self.tags = [(SPACE, 0)]
        # where each code point's symbols lie in self.flat, how many they are, and whether composition leaves it alone
        self.at, self.n, self.plain = np.full(0x110000, -1, np.int32), np.zeros(0x110000, np.int8), np.zeros(0x110000, bool)
        self.flat = np.zeros(0, np.int32)
        self.stride = 128
        self.forget()
        self.learn(np.arange(128))

    # ---- symbols --------------------------------------------------------------

    def learn(self, points: np.ndarray) -> None:
        """Compile code points: the bytes of their normal form, each tagged with the class of its character."""
        for p in points.tolist():
            c, out = chr(p), []
            for d in self.normalize(c):
                if not self.split(d):
                    out.append((SPACE, 0))
                    continue
                tag = "L" if len(self.split("a" + d)) == 1 else "N" if len(self.split(d + d)) == 2 else "O"
                out += [("n" if tag == "N" and k else tag, b) for k, b in enumerate(d.encode())]
            ids = [self.symbols.setdefault(s, len(self.symbols)) for s in out]
            self.tags = list(self.symbols)
            self.at[p], self.n[p] = len(self.flat), len(ids)
            self.flat = np.append(self.flat, np.array(ids, np.int32))
            jamo = 0x1100 <= p < 0x1200
            self.plain[p] = not jamo and unicodedata.category(c)[0] != "M" and unicodedata.category(c) != "Cn" and unicodedata.is_normalized("NFC", c)
        if len(self.symbols) > self.stride:
            self.stride = 1 << (len(self.symbols) - 1).bit_length()
            self.forget()

    def points(self, text: str) -> np.ndarray:
        out = np.frombuffer(text.encode("utf-32-le"), np.int32)
        unknown = self.at[out] < 0
        if unknown.any():
            self.learn(np.unique(out[unknown]))
        return out

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the symbols of all texts, a closing space behind each; where each ends). The texts hold no special tokens."""
        if all(map(str.isascii, texts)):  # a character is a symbol
            x = self.flat[self.at[np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)]]
            return x, np.cumsum([len(t) + 1 for t in texts])
        points = self.points("\n".join([*texts, ""]))
        if not self.plain[points].all():
            texts = [t if self.plain[self.points(t)].all() else self.compose(t) for t in texts]
            points = self.points("\n".join([*texts, ""]))
        n = self.n[points]
        ends = np.cumsum(n, dtype=np.int32)
        shift = np.repeat(self.at[points] - ends + n, n)
        shift += np.arange(len(shift), dtype=np.int32)
        return self.flat[shift], ends[np.cumsum([len(t) + 1 for t in texts]) - 1].astype(np.int64)

    # ---- states ---------------------------------------------------------------

    def forget(self) -> None:
        self.merges.forget()
        self.kinds: list[tuple[str, int]] = [START]
        self.number: dict[tuple[str, int], int] = {START: 0}
        self.table = np.zeros((MAX_CELLS // self.stride, self.stride), np.int32)

    def moved(self, kind: str, inner: int, tag: str, byte: int) -> tuple[str, int, int]:
        """(kind, inner state, tokens added) after a byte of a character of class ``tag``."""
        merges, n = self.merges, 0
        if kind in ("'r", "'v", "'l"):
            first = ord(kind[1])
            if tag == "L" and byte == TWO[first]:
                return *START, merges.of_word(bytes([APOSTROPHE, first, byte]))
            n += merges.of_word(b"'")
            inner, added = merges.step(0, first)
            kind, n = "L", n + added
        elif kind == "'":
            if tag == "L" and byte in ONE:
                return *START, merges.of_word(bytes([APOSTROPHE, byte]))
            if tag == "L" and byte in TWO:
                return "'" + chr(byte), 0, 0
            if tag == "O":
                inner, n = merges.step(0, APOSTROPHE)
                kind = "O"
            else:
                n += merges.of_word(b"'")
                kind = ""
        if tag == kind in ("L", "O") or (kind, tag) == ("N", "n"):
            inner, added = merges.step(inner, byte)
            return kind, inner, n + added
        if kind:
            n += merges.close(inner)
        if tag == SPACE:
            return *START, n
        if (tag, byte) == ("O", APOSTROPHE):
            return "'", 0, n
        inner, added = merges.step(0, byte)
        return tag, inner, n + added

    def compile(self, cells: np.ndarray, limit: bool) -> None:
        """Fill cells of the table: next state times 256, plus tokens added plus 128; an empty cell is 0."""
        for cell in np.unique(cells).tolist():
            state, symbol = divmod(cell, self.stride)
            *to, added = self.moved(*self.kinds[state], *self.tags[symbol])
            to = tuple(to)
            at = self.number.get(to)
            if at is None:
                at = self.number[to] = len(self.kinds)
                self.kinds.append(to)
                if at >= len(self.table):
                    if limit:
                        raise Full
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[state, symbol] = at << 8 | added + 128

    # ---- runs -----------------------------------------------------------------

    def run(self, x: np.ndarray, start: np.ndarray, length: np.ndarray, entry: np.ndarray, limit: bool) -> tuple[np.ndarray, np.ndarray]:
        """(exit state, tokens) of each chunk from its entry state, all side by side."""
        order = np.argsort(-length, kind="stable")
        at, state, n = start[order].astype(np.int32), entry[order].astype(np.int32), np.zeros(len(order), np.int32)
        live = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), "left")
        for m in live.tolist():
            cells = state[:m] * np.int32(self.stride) + x.take(at[:m])
            found = self.table.ravel().take(cells)
            if not found.all():
                self.compile(cells[found == 0], limit)
                found = self.table.ravel().take(cells)
            state[:m] = found >> 8
            n[:m] += (found & 255) - 128
            at[:m] += 1
        exits, tokens = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        exits[order], tokens[order] = state, n
        return exits, tokens

    def chunks(self, x: np.ndarray, size: int) -> list[tuple[int, int, bool]]:
        """(start, length, whether it begins inside a run without white space) of a text's symbols."""
        if len(x) <= size:
            return [(0, len(x), False)]
        spaces, out, at, hard = np.flatnonzero(x == 0), [], 0, False
        while at < len(x):
            end = min(at + size, len(x))
            k = int(np.searchsorted(spaces, end - 1, "right"))  # spaces up to the last symbol of a full chunk
            soft = k > 0 and spaces[k - 1] >= at
            end = int(spaces[k - 1]) + 1 if soft else end
            out.append((at, end - at, hard))
            at, hard = end, not soft
        return out

    def counts(self, texts: list[str], size: int = CHUNK, limit: bool = True) -> np.ndarray:
        """The number of tokens of each text."""
        if len(self.kinds) > WORN * len(self.table) or self.table.size > MAX_CELLS:
            self.forget()
        special, parts, owner = np.zeros(len(texts), np.int64), [], []
        for k, text in enumerate(texts):
            pieces = self.special.split(text) if self.special.search(text) else [text]
            special[k] = len(pieces) - 1
            parts += pieces
            owner += [k] * len(pieces)
        if not parts:
            return special
        x, ends = self.read(parts)
        lanes = [(a + at, n, hard, k) for k, (a, b) in enumerate(zip(np.append(0, ends).tolist(), ends.tolist())) for at, n, hard in self.chunks(x[a:b], size)]
        start, length, hard, part = (np.array(c, np.int64) for c in zip(*lanes, strict=True))
        try:
            per_part = self.composed(x, start, length, hard.astype(bool), part, len(parts), limit)
        except Full:
            self.forget()
            half = len(texts) // 2
            return np.concatenate([self.counts(texts[:half], size), self.counts(texts[half:], size)]) if half else self.counts(texts, size, False)
        return special + np.bincount(np.array(owner, np.int64), per_part, len(texts)).astype(np.int64)

    def composed(self, x, start, length, hard, part, n_parts, limit) -> np.ndarray:
        """Tokens of each part: its chunks' state maps, composed."""
        entry = np.zeros(len(start), np.int64)
        back = np.minimum(GUESS, start)[hard]
        entry[hard] = self.run(x, start[hard] - back, back, np.zeros(hard.sum(), np.int64), limit)[0]
        lane = np.arange(len(start))
        out, n = self.run(x, start, length, entry, limit)
        follows = np.append(part[1:] == part[:-1], False)
        while True:
            key = lane << 32 | entry
            order = np.argsort(key)
            want = (lane + 1) << 32 | out
            to = order[np.searchsorted(key, want, sorter=order).clip(max=len(key) - 1)]
            missing = follows[lane] & (key[to] != want)
            if not missing.any():
                break
            new = np.unique(want[missing])
            lanes, states = new >> 32, new & 0xFFFFFFFF
            exits, more = self.run(x, start[lanes], length[lanes], states, limit)
            lane, entry, out, n = (np.concatenate(p) for p in ((lane, lanes), (entry, states), (out, exits), (n, more)))
        sink = len(lane)
        to, n = np.append(np.where(follows[lane], to, sink), sink), np.append(n, 0)
        while (to != sink).any():
            n, to = n + n[to], to[to]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        per_part = np.zeros(n_parts, np.int64)
        per_part[part[first]] = n[first]
        return per_part


@lru_cache(maxsize=2)
def transducer(path: str | None) -> Transducer:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Transducer(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    n_tokens is what the tokenizer file gives without begin and end; a special token
    written in a text counts as one.  Null texts count as empty: no bytes, no tokens.
    Null and repeated doc_ids keep their rows; other columns are ignored.  ``path`` is a
    file of the named kind; the default is the public 49k vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            texts, sizes, group, room = batch.column(1), [], [], 0
            counted = []
            for k in range(batch.num_rows):
                text = texts[k].as_py() or ""
                sizes.append(len(text.encode()))
                group.append(text)
                room += len(text)
                if room > TOGETHER or k + 1 == batch.num_rows:
                    counted.append(machine.counts(group))
                    group, room = [], 0
            n = np.concatenate([np.zeros(0, np.int64), *counted])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
