"""Hard negatives, fill-in-middle and token counts against brute force and the tokenizer library, with odd tables."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm import fill_middle, hard_negatives, token_counts

DOCS = "doc_id long, text string"


# ---- hard negatives -----------------------------------------------------------


def brute_negatives(rows, every=100, n_positives=5, n_negatives=10):
    kept = set()
    for v, label, x in rows:
        if v is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        kept.add((v, (label + 1) % 10 if v % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(c))) for c in x)))
    out = []
    for a in sorted(kept):
        if a[0] % every:
            continue
        score = {r: sum(x * y for x, y in zip(a[2], r[2])) for r in kept}
        first = lambda rs, k: sorted(rs, key=lambda r: (-score[r], r[0]))[:k]
        for p in first([r for r in kept if r[1] == a[1] and r[0] != a[0]], n_positives):
            hard = first([r for r in kept if r[1] != a[1] and 30 * score[p] <= 100 * score[r] <= 90 * score[p]], n_negatives)
            out += [(a[0], p[0], k + 1, r[0], score[p], score[r]) for k, r in enumerate(hard)]
    return sorted(out)


def vectors(seed, n, width=24, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, width))
    labels = rng.integers(0, 10, n)
    x = rng.normal(size=(n, width)) * spread + centres[labels % 4]
    return [(int(i), int(label), [float(c) for c in v]) for i, label, v in zip(range(n), labels, x)]


SCHEMA = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize("block", [8, 1000])
def test_hard_negatives_brute_force(spark, block):
    rows = vectors(5, 400)
    rows += [(1000 + i, 3, rows[7][2]) for i in range(60)] + [rows[8]] * 40  # one vector very often, one row very often
    rows += [(100, 5, rows[3][2]), (2000, 1, [0.0] * 24), (None, 1, rows[0][2]), (2001, None, rows[0][2]), (2002, 1, None)]
    rows += [(2003, 1, [None] + [1.0] * 23), (2004, 1, [float("nan")] * 24), (2100, 2, [float("inf")] * 24), (2200, 2, [-x for x in rows[0][2]])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"q": F.lit(1), "summary": F.lit("x"), "score": F.lit(2.0)})
    got = sorted(map(tuple, hard_negatives.hard_negatives(df, every=20, block=block).collect()))
    assert got == brute_negatives(rows, every=20) and len(got) > 500


def test_hard_negatives_of_few_rows_and_none(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.5, 0.5]), (100, 4, [1.0, 1.0])]
    assert sorted(map(tuple, hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect())) == brute_negatives(rows)
    assert hard_negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    large = [(100, 1, [3e30] * 4), (101, 1, [3e30] * 4), (102, 2, [2e30, 2e30, 0.0, 0.0])]  # cut to LARGEST: no score leaves 64 bits
    (only,) = hard_negatives.hard_negatives(spark.createDataFrame(large, SCHEMA)).collect()
    assert (only.positive_score, only.negative_score) == (4 * 2**52, 2 * 2**52)


def test_bounds_rule_out_no_pair_within_the_limits():
    rng = np.random.default_rng(2)
    q = np.concatenate([rng.integers(-90, 90, (300, 32)), rng.integers(-3000, 9000, (300, 1)) + rng.integers(-9, 9, (300, 32))]).astype(np.int32)
    notes = np.concatenate([p for level in hard_negatives.summaries(q) for p in level], 1)
    rows = hard_negatives.Rows(range(600), [0] * 600, [v.tobytes() for v in q], [v.tobytes() for v in notes])
    exact = q.astype(np.int64) @ q.T.astype(np.int64)
    for share in (0.5, 0.9, 0.999):
        least, most = np.quantile(exact, share, axis=1).astype(np.int64), np.full(600, hard_negatives.HIGHEST)
        i, j, score = hard_negatives.survivors(rows, rows, least, most)
        want = np.nonzero(exact >= least[:, None])
        assert sorted(zip(i.tolist(), j.tolist(), score.tolist())) == sorted(zip(want[0].tolist(), want[1].tolist(), exact[want].tolist()))


# ---- fill in middle -----------------------------------------------------------


def brute_fill(doc_id, text):
    text = text or ""
    name = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(name[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    p, q = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    x, y, z = text[:p], text[p:q], text[q:]
    form, out = ("spm", f"<S>{z}<P>{x}<M>{y}") if h[3] % 100 < 20 else ("psm", f"<P>{x}<S>{z}<M>{y}")
    return (doc_id, n, form, p, q - p, sha(out), sha(text))


@pytest.mark.parametrize("size", [1, 3, 7, 1 << 16])
def test_fill_in_middle_brute_force(spark, size):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab<>PSM é\U0001f600\n\0", k=rng.randint(0, 60))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (7, "twice"), (7, "twice"), (8, None), (9, ""), (10, "a<M>b"), (11, "<P"), (12, "é" * 200_000 if size > 9 else "é")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"n": F.lit("x"), "frames": F.lit(1)})
    got = fill_middle.transformed(fill_middle.stored(df, size), size, with_output=True).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted((brute_fill(*r) for r in rows), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    expand = zstandard.ZstdDecompressor().decompress
    for r in got:
        frames = [tuple(f) for f in r.output]
        assert all(f[1] <= size for f in frames) and [f[0] for f in frames] == [sum(f[1] for f in frames[:k]) for k in range(len(frames))]
        assert hashlib.sha256(b"".join(expand(bytes(f[2])) for f in frames)).hexdigest() == r.output_sha256


def test_only_the_frames_of_a_range_are_opened():
    opened, text = [], "".join(map(chr, range(300, 1300)))
    frames = fill_middle.Frames.of([text[:450], text[450:]], zstandard.ZstdCompressor().compress, 100)

    def expand(data):
        opened.append(data)
        return zstandard.ZstdDecompressor().decompress(data)

    assert "".join(frames.read(250, 310, expand)) == text[250:310] and len(opened) == 2
    assert "".join(frames.read(300, 400, expand)) == text[300:400] and len(opened) == 3
    assert "".join(frames.read(5, 5, expand)) == "" and "".join(frames.read(990, 2000, expand)) == text[990:]
    assert frames.find(text[398:402], 0, expand) == 398 and frames.find("none", 0, expand) == -1


def test_fill_in_middle_of_nothing(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], DOCS)).collect() == []


# ---- token counts -------------------------------------------------------------

ODD = [
    "", " ", "a", "don't", "don'tx ''s !'s 're 'rx 'r 'l 'll 'lx 'v ve's", "x'", "'", "½ ⅷ १२ 3'4", "İstanbul ÇA ﬁ", "<|endoftext|>a<|startoftext|>b <|endoftext|",
    "\x1c\x1da\x85b c​d", "ΣΑΣ ΟΔΟΣ", "éà 한", "日本語テキスト", "👍🏽 ok!!!???", "a" * 5000, "ab" * 3000, "!" * 4000, "xyzzy" * 900, "'" * 3000, "é" * 3000, "1" * 3000,
    "<|endoftext|≯x", "a̸ ̸<|startoftext|>", "word " * 2000, "\0\n\t\r\x0b",
]


@pytest.fixture(scope="module")
def library():
    file = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda texts: [len(e.ids) for e in file.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("size", [5, 64, 1024])
def test_transducer_counts_as_the_library(library, size):
    machine, rng = token_counts.transducer(None), random.Random(size)
    alphabets = ["ab", "aeiou thrsn", "abcdefghij'! 12", "'srevldm x!", "éèàç ñüß’“”…", "".join(map(chr, range(0x20, 0x600))), "<|endoftext|> a"]
    texts = ODD + ["".join(rng.choices(a, k=rng.randint(0, 150))) for a in alphabets for _ in range(60)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF), rng.randint(32, 126)])) for _ in range(40)) for _ in range(60)]
    assert machine.counts(texts, size).tolist() == library(texts)
    assert machine.counts([]).tolist() == []


def test_transducer_begins_anew_when_full(library, monkeypatch):
    machine, rng = token_counts.Transducer(public_tokenizers.path("word_bpe_49k.json")), random.Random(1)
    monkeypatch.setattr(token_counts, "MAX_CELLS", machine.stride * 300)
    machine.forget()
    texts = ["".join(rng.choices("abcdefghijklmnopqrst ", k=200)) for _ in range(30)] + ["".join(rng.choices("abcdefghijklmnopqrst", k=3000))]
    assert machine.counts(texts).tolist() == library(texts)
    assert machine.counts(texts[:3]).tolist() == library(texts[:3]) and len(machine.table) == 300


def test_state_maps_of_cuts_inside_a_run_compose(library):
    machine = token_counts.transducer(None)
    texts = ["a" * 999, "ab" * 777, "the" * 500, "zq" * 400 + "zz" * 301, "é" * 501]
    assert machine.counts(texts, 16).tolist() == library(texts)
    x = machine.read(["a" * 100])[0]
    assert [hard for _, _, hard in machine.chunks(x, 16)] == [False] + [True] * 6


def test_token_counts_of_rows(spark, library):
    rows = [(1, "two words"), (1, "two words"), (None, "x"), (2, None), (3, ""), (4, "tok " * 2049), (5, "tok " * 2048), (6, "é<|endoftext|>")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"n_tokens": F.lit("own"), "x": F.lit(1)})
    got = token_counts.token_counts(df).collect()
    want = [(i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, library([t or "" for _, t in rows]))]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(spark.createDataFrame([], DOCS)).collect() == []
