"""Operators on documents against brute force, with nulls, blanks, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from vellum.llm import components, lm_score, packing, quality_rules, sharding, simhash, substrings, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, start=1, extra=()):
    rows = [(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


@pytest.fixture(scope="module")
def prose():
    rng = np.random.default_rng(3)
    vocabulary = ["w%d" % i for i in range(400)] + ["Ébène", "the", "OF", "naïve"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    shared = text(70)
    out = [text(int(n)) for n in rng.integers(1, 160, 40)]
    out += [None, "", " \n\t", "one", "two words", out[3], out[3], out[5].upper()]
    out += [f"{text(30)} {shared} {text(20)}" for _ in range(5)]
    out += [out[7] + " tail", shared, "x " + shared, "\n".join(["same line here"] * 30), "a b c " * 60, text(3000)]
    return out


def brute_print(text):
    words = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if bin(prints[i] ^ prints[j]).count("1") <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_simhash_brute_force(spark, prose):
    docs = frame(spark, prose)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    want = {i + 1: brute_print(t) for i, t in enumerate(prose)}
    assert {k: v[0] for k, v in got.items()} == want
    assert {k: v[1] for k, v in got.items()} == brute_components(want)


def test_simhash_dense_groups_are_salted(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 2**63))
    prints = {centre}
    while len(prints) < 700:
        v = centre
        for b in rng.integers(0, 64, rng.integers(0, 8)):
            v ^= 1 << int(b)
        prints.add(v)
    prints = np.array(sorted(prints), np.uint64)
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long"), group=64).collect()
    at = {x: i for i, x in enumerate(prints.view(np.int64).tolist())}
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 3
    assert all(near[at[e.a], at[e.b]] or e.a != e.b for e in edges)
    want = simhash.forest(len(prints), iter([np.nonzero(near)]))
    got = simhash.forest(len(prints), iter([(np.array([at[e.a] for e in edges]), np.array([at[e.b] for e in edges]))]))
    assert (want == got).all()
    assert len(edges) < len(prints) * 30 * 4  # forests, not all pairs


def test_components_of_many_edges_do_not_overflow(spark):
    """The test of convergence must hold for values whose sum passes a long."""
    edges = spark.range(200_000).selectExpr("id * 46116860184273 as a", "(id div 2) * 46116860184273 as b")
    got = components.connected_components(edges)
    assert got.count() == 200_000 and got.select("component").distinct().count() == 1
    total = edges.selectExpr("sum(cast(pmod(xxhash64(a, b), 1L << 62) as decimal(38, 0))) as s").first().s
    assert total > 2**63


def test_simhash_keeps_one_of_a_group_and_all_columns(spark, prose):
    docs = frame(spark, [prose[0], prose[0], prose[1]], extra=[(None, prose[0], "en", "s", 1)])
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 3]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(spark, prose):
    texts = [*prose, "a b c a b c", "x\n x\nx\n\n \nx", "### a|b <c>", "é è ê", "a" * 100_000]
    got = {r.doc_id: r for r in quality_rules.verdicts(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i + 1]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_words_of_long_texts_are_hashed_alike(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "é", "x" * 300], 500)), "", "y" * 1_000 + " a", " "]
    whole = next(words.iter_slices(pa.array(texts), lower=False)).hashes
    monkeypatch.setattr(words, "SLICE_BYTES", 64)
    pieces = np.concatenate([w.hashes for w in words.iter_slices(pa.array(texts), lower=False, slice_bytes=10**9)])
    assert (whole == pieces).all() and len(np.unique(whole)) == 6


def test_very_long_texts(spark):
    """One text of 7 MB, more than a slice, beside short ones, through the operators on words."""
    rng = np.random.default_rng(6)
    long_ = " ".join(f"w{x}" for x in rng.integers(0, 1_000_000, 900_000))
    docs = frame(spark, [long_, "short one", long_[: 1 << 20]])
    rules = {r.doc_id: r.n_words for r in quality_rules.verdicts(docs).collect()}
    assert rules[1] == 900_000 and rules[2] == 2
    assert {r.doc_id for r in simhash.near_duplicates(docs).collect()} == {1, 2, 3}
    scored = {r.doc_id: r for r in lm_score.scores(docs).collect()}
    assert scored[1].n_tokens == 900_001 and all(math.isfinite(r.score) for r in scored.values())
    left = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.without_repeats(docs).collect()}
    assert left[1] == (900_000, 0) and left[3][1] >= left[3][0] - 1
    pieces = packing.packed(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("piece").alias("last")).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3} and max(r.last for r in pieces) > 1_000


def test_quality_policies_and_ablations(spark):
    good = " ".join(f"word{i}" for i in range(80))
    docs = frame(spark, [good, "a b c " * 60, good.replace(" ", " ### "), None, good + " other"], extra=[(None, good, "en", "s", 3)])
    rows = quality_rules.ledger(docs)
    told = {r.rule: r for r in quality_rules.ablations(rows, "v1").collect()}
    assert told["symbols"].failed_alone == 1 and told["repeated_windows"].failed == 1
    assert told["too_few_words"].failed_alone == 1 and told["too_few_words"].kept_without == 4
    left = quality_rules.keep_good(docs)
    assert left.columns == docs.columns and sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 5]
    assert {r.failed for r in quality_rules.ablations(rows.limit(0), "v1").collect()} == {0}


def test_sharding_law(spark, prose):
    docs = frame(spark, prose * 5).withColumnRenamed("source", "slot")
    got = sharding.shards(docs).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.text) == sorted((i + 1, t) for i, t in enumerate(prose * 5) if t)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    counts = [len(by[s]) for s in range(24)]
    assert sum(counts) == len(prose) * 5 and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shards(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] != sorted(r.doc_id for r in got)
    assert sharding.shards(docs.limit(0)).count() == 0
    few = sharding.shards(docs.where("doc_id <= 3")).collect()
    assert len({r.shard for r in few}) == 3 and all(r.slot == 0 for r in few)


def test_sharding_buckets_are_many_and_repeats_stay(spark):
    docs = frame(spark, [f"text {i}" for i in range(200)]).unionByName(frame(spark, ["text 0"]))
    placed, n = sharding.shuffled(docs, bucket_bytes=100)
    assert n == 201 and sorted(r.position for r in placed.collect()) == list(range(201))


def test_sharding_deals_out_rows_that_repeat_very_often(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 70)
    docs = frame(spark, [f"text {i}" for i in range(100)]).unionByName(spark.range(1_000).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text", "'en' as lang", "'s' as source", "0 as n_chars"))
    tagged = frame(spark, ["same"] * 3).withColumn("doc_id", F.lit(7_777).cast("long")).withColumn("lang", F.monotonically_increasing_id().cast("string"))
    docs = docs.unionByName(tagged)
    placed, n = sharding.shuffled(docs, bucket_bytes=2_000)
    rows = placed.withColumn("part", F.spark_partition_id()).collect()
    assert n == len(rows) == 1_103 and sorted(r.position for r in rows) == list(range(1_103))
    blank = Counter(r.part for r in rows if r.doc_id is None)
    assert sum(blank.values()) == 1_000 and max(blank.values()) < 100  # of over 30 parts
    assert sorted(r.lang for r in rows if r.doc_id == 7_777) == sorted(r.lang for r in tagged.collect())
    spread = lambda d: sorted((r.doc_id or 0, r.lang, r.position) for r in sharding.shuffled(d, bucket_bytes=2_000)[0].collect())
    assert spread(docs.where("doc_id is null or doc_id <> 7777")) == spread(docs.where("doc_id is null or doc_id <> 7777").repartition(7))


def test_packing_ids_and_places(spark, prose):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [*prose, "it's don't I'LL   x", "日本語 123  4", "<|endoftext|> hi", "a<|endoftext|>b <|endoftext|>", "<|endoftext|", "\x1c a", "😀 hi²", "a b"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i + 1: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    got = packing.packed(frame(spark, texts), with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == want[r.doc_id][r.start : r.start + r.length] and zlib.crc32(r.ids) == r.ids_crc32
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, ids in want.items():
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts))) and sum(p.length for p in parts) == len(ids)
        assert all(p.length == 1024 for p in parts[1:])
    for rows in by_sequence.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.packed(frame(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_uses_each_piece_once_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(np.clip(rng.gamma(1 + seed, 150, 20_000).astype(int), 1, 1024).tolist())
    made = packing.plan(dict(counts))
    used = Counter()
    for times, lengths in made:
        assert sum(lengths) <= 1024
        for n in lengths:
            used[n] += times
    assert used == counts
    floor = max(-(-sum(n * c for n, c in counts.items()) // 1024), sum(c for n, c in counts.items() if n > 512))
    assert sum(t for t, _ in made) <= floor * 1.02 + 1
    ranks = packing.places(made)
    assert all(rows[0, 0] == 0 for rows in ranks.values())


def brute_removed(texts):
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    least = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            least.setdefault(tuple(words[i][k : k + 50]), i)
    out = {}
    for i, ws in words.items():
        gone = {p for k in range(len(ws) - 49) if least[tuple(ws[k : k + 50])] < i for p in range(k, k + 50)}
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        out[i] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("crowded", "filtered"), [(2_000, True), (2, True), (2_000, False), (2, False)])
def test_substrings_brute_force(spark, prose, crowded, filtered, monkeypatch):
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    rng = np.random.default_rng(8)
    near = []
    base = prose[-1].split()[:400]
    for _ in range(12):  # near copies: matches that start and end anywhere
        words = list(base)
        for at in rng.integers(0, 400, 6):
            words[at] = f"edit{rng.integers(1e6)}"
        near.append(" ".join(words))
    texts = {i + 1: t for i, t in enumerate([*prose, *near, "r " * 300, "q " + "r " * 200, " ".join(base + base)])}
    docs = frame(spark, list(texts.values()))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.without_repeats(docs, filtered).collect()}
    assert got == brute_removed(texts)


def test_substrings_nulls_repeated_ids_and_columns(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [long], extra=[(None, long, "en", "s", 1), (1, long, "en", "s", 1), (2, long + "  tail", "en", "s", 1), (3, "short  text", "en", "s", 1)])
    docs = docs.withColumnRenamed("lang", "n_words")
    got = substrings.without_repeats(docs).collect()
    assert sorted(((r.doc_id or 0), r.n_removed, r.text) for r in got) == [(0, 0, long), (1, 0, long), (1, 0, long), (2, 60, "tail"), (3, 0, "short  text")]
    assert substrings.without_repeats(docs.limit(0)).count() == 0


def test_suffix_automaton_matching():
    rng = np.random.default_rng(2)
    for _ in range(30):
        seqs = [rng.integers(0, 3, rng.integers(1, 30)).tolist() for _ in range(3)]
        query = rng.integers(0, 3, 25).tolist()
        made = substrings.SuffixAutomaton()
        for s in seqs:
            made.add(s)
        subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i, len(s) + 1)}
        want = [max(n for n in range(k + 2) if tuple(query[k + 1 - n : k + 1]) in subs) for k in range(len(query))]
        assert made.matching(query) == want


def test_language_model_counts_and_base(spark, prose, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 3_000)
    docs = frame(spark, prose, extra=[(None, "of the", "en", "s", 1)])
    got = {r.doc_id: r for r in lm_score.scores(docs).collect()}
    lower = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [None]
    tokens = {i + 1: lower(t) for i, t in enumerate(prose)} | {None: lower("of the")}
    count = Counter()
    held = {i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i in tokens}
    for i, ws in tokens.items():
        if not held[i]:
            count.update(ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_language_model_learns_bigrams(spark):
    rng = np.random.default_rng(4)
    after = {w: rng.choice(60, 3) for w in range(60)}
    texts = []
    for _ in range(300):
        w, out = int(rng.integers(60)), []
        for _ in range(60):
            out.append(f"t{w}")
            w = int(rng.choice(after[w]))
        texts.append(" ".join(out))
    rows = [r for r in lm_score.scores(frame(spark, texts)).collect() if r.held_out]
    per = lambda c: -sum(r[c] for r in rows) / sum(r.n_tokens for r in rows)
    assert len(rows) > 20 and per("score") < 0.6 * per("base_score")
    assert lm_score.scores(frame(spark, texts).limit(0)).count() == 0


def copied(spark):
    """Documents of one file, and the ids of a training and a held-out copy of a text of words that nothing else has."""
    held = next(i for i in range(50, 99) if zlib.crc32(str(i).encode()) % 7 == 2)
    train = next(i for i in range(1, 50) if zlib.crc32(str(i).encode()) % 7 != 2)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, 60)) for _ in range(100)]
    texts[train] = texts[held] = " ".join(f"rare{i} rare{i + 1000}" for i in range(30))
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).coalesce(1), train, held


def test_language_model_finds_pairs_of_other_blocks(spark, monkeypatch):
    docs, train, held = copied(spark)
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 2_000)
    got = {r.doc_id: r.score for r in lm_score.scores(docs).collect()}
    assert math.isclose(got[held], got[train], rel_tol=1e-9) and got[held] > -60


def test_language_model_is_the_same_for_one_block_and_many(spark, monkeypatch):
    docs, _, _ = copied(spark)
    one = {r.doc_id: r.score for r in lm_score.scores(docs).collect()}
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 2_000)
    many = {r.doc_id: r.score for r in lm_score.scores(docs).collect()}
    assert all(math.isclose(one[i], many[i], rel_tol=1e-6) for i in one)


def test_language_model_seats_again_by_what_was_sent_up(spark, prose, monkeypatch):
    monkeypatch.setattr(lm_score, "ROUNDS", 2)
    two = {r.doc_id: r.score for r in lm_score.scores(frame(spark, prose)).collect()}
    monkeypatch.setattr(lm_score, "ROUNDS", 4)
    four = {r.doc_id: r.score for r in lm_score.scores(frame(spark, prose)).collect()}
    assert any(two[i] != four[i] for i in two) and math.isclose(sum(two.values()), sum(four.values()), rel_tol=0.05)


def stirling_mean(c, new, discount):
    """Exact mean number of tables of c customers, by the recursion of the generalised Stirling numbers."""
    t, weight = np.arange(c + 1), np.zeros(c + 1)
    weight[1] = 1
    for n in range(1, c):
        weight = np.maximum(n - t * discount, 0) * weight + new * np.append(0.0, weight[:-1])
        weight /= weight.max()
    return (t * weight).sum() / weight.sum()


def partitions_mean(c, new, discount):
    """The same by listing all seatings of c customers."""
    seatings = [[]]
    for _ in range(c):
        seatings = [s[:k] + [s[k] + 1] + s[k + 1 :] for s in seatings for k in range(len(s))] + [[*s, 1] for s in seatings]
    weight = [new ** len(s) * math.prod(math.gamma(n - discount) / math.gamma(1 - discount) for n in s) for s in seatings]
    return sum(len(s) * w for s, w in zip(seatings, weight, strict=True)) / sum(weight)


def drawn_mean(c, new, discount, n=20_000):
    seed = lm_score.mix(np.arange(n, dtype=np.uint64) + np.uint64(c))
    return lm_score.draw_tables(np.full(n, c), np.full(n, new), discount, seed).mean()


@pytest.mark.parametrize("discount", [0.3, 0.7, 0.9])
def test_seating_follows_the_exact_law(discount, monkeypatch):
    for c, new in ((2, 0.5), (5, 1.0), (7, 4.0)):
        assert math.isclose(stirling_mean(c, new, discount), partitions_mean(c, new, discount), rel_tol=1e-9)
    for c, new in ((2, 0.5), (7, 1.0), (12, 0.5), (13, 0.5), (50, 0.5), (200, 0.5), (200, 40.0), (2_000, 3.0), (2_000, 40.0), (2_000, 400.0)):
        assert math.isclose(drawn_mean(c, new, discount), stirling_mean(c, new, discount), rel_tol=0.02)
    monkeypatch.setattr(lm_score, "TABLED", 256)
    for new in (0.5, 20.0):  # the same on both sides of the tabled counts
        assert math.isclose(drawn_mean(600, new, discount), stirling_mean(600, new, discount), rel_tol=0.03)


def test_seating_edges():
    t = lm_score.draw_tables(np.array([0, 1, 2, 2, 10**9]), np.array([1.0, 1.0, 1e-12, 1e12, 1e-3]), 0.5, np.arange(5, dtype=np.uint64))
    assert t.tolist()[:4] == [0, 1, 1, 2] and 1 <= t[4] <= 3
    assert len(lm_score.draw_tables(np.zeros(0, np.int64), np.zeros(0), 0.5, np.zeros(0, np.uint64))) == 0


def brute_scores(tokens, held, rounds):
    """{document: score} by dictionaries, with the module's draws; every predictive law is checked to sum to one."""
    name = lambda w: int(lm_score.START if w == "<" else lm_score.END if w is None else next(lm_score.iter_slices(pa.array([w]), lower=False)).hashes[0])
    c, pairs, starts = Counter(), Counter(), 0
    for i, ws in tokens.items():
        if not held[i]:
            c.update(ws)
            pairs.update(zip(["<", *ws[:-1]], ws, strict=True))
            starts += 1
    hashes = {w: name(w) for w in {*(w for ws in tokens.values() for w in ws), "<"}}
    n, v = sum(c.values()), len(c)
    discount = lambda counts: lm_score._discount(*(sum(x == k for x in counts) for k in (1, 2)))
    d1, d2, theta = discount(c.values()), discount(pairs.values()), lm_score.STRENGTH
    of = lambda u: starts if u == "<" else c[u]
    u64 = lambda x: np.array([x % 2**64], np.uint64)

    def seat(count, new, d, key):
        return float(lm_score.draw_tables(np.array([count]), np.array([new]), d, lm_score.mix(u64(key)))[0])

    def pair_hash(u, w):
        return int(lm_score.mix(u64(hashes[u] * 0x9E3779B97F4A7C15 + int(lm_score.mix(u64(hashes[w] + 1))[0])))[0])

    new, laws, tables1 = {}, [], 0
    for turn in range(rounds):
        t = {k: seat(x, new[k], d2, pair_hash(*k) + turn) if turn else 1.0 for k, x in pairs.items()}
        by_u, by_w = Counter(), Counter()
        for (u, w), x in t.items():
            by_u[u] += x
            by_w[w] += x
        top = {w: seat(int(x), (theta + d1 * tables1) / (v + 1), d1, hashes[w] + turn) if turn else 1.0 for w, x in by_w.items()}
        customers1, tables1 = sum(by_w.values()), sum(top.values())
        unigram = {w: (by_w[w] - d1 * top.get(w, 0) + (theta + d1 * tables1) / (v + 1)) / (theta + customers1) for w in [*c, "?"]}
        law = lambda u, w, t=t, by_u=by_u, g=unigram: (pairs[u, w] - d2 * t.get((u, w), 0) + (theta + d2 * by_u[u]) * g.get(w, g["?"])) / (theta + of(u))
        for u in ["<", *list(c)[:20], "never seen"]:
            assert math.isclose(sum(law(u, w) for w in [*c, "?"]), 1, rel_tol=1e-9)
        new = {(u, w): (theta + d2 * by_u[u]) * unigram[w] for u, w in pairs}
        laws.append(law)
    return {i: sum(math.log10(sum(law(u, w) for law in laws[1:]) / (rounds - 1)) for u, w in zip(["<", *ws[:-1]], ws, strict=True)) for i, ws in tokens.items()}


@pytest.mark.parametrize("block_bytes", [3 << 20, 3_000])
def test_language_model_scores_brute_force(spark, prose, monkeypatch, block_bytes):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block_bytes)
    docs = frame(spark, prose, extra=[(4, prose[3], "en", "s", 1), (4, prose[3], "en", "s", 1)]).withColumnRenamed("lang", "score").withColumnRenamed("source", "held_out")
    got = sorted((r.doc_id, r.score) for r in lm_score.scores(docs).collect())
    lower = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [None]
    tokens = {(i + 1, 0): lower(t) for i, t in enumerate(prose)} | {(4, 1): lower(prose[3]), (4, 2): lower(prose[3])}
    want = brute_scores(tokens, {k: zlib.crc32(str(k[0]).encode()) % 7 == 2 for k in tokens}, lm_score.ROUNDS)
    assert len(got) == len(want)
    for (i, score), ((j, _), expected) in zip(got, sorted(want.items()), strict=True):
        assert i == j and math.isclose(score, expected, rel_tol=1e-6)


def test_substrings_keep_columns_of_any_name(spark, prose):
    extra = {n: F.lit(n) for n in ("__id", "__hash", "__spans", "__text_hash", "own_hash", "own_id", "lost_at", "other_hash", "_own_hash", "a b")}
    docs = frame(spark, prose).withColumns(extra)
    plain = {r.doc_id: (r.text, r.n_removed) for r in substrings.without_repeats(frame(spark, prose)).collect()}
    got = substrings.without_repeats(docs)
    assert got.columns == [*docs.columns, "n_words", "n_removed", "kept_sha256"]
    rows = got.collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in rows} == plain and all(r[n] == n for r in rows for n in extra)


def test_shards_of_many_buckets_in_runs(spark, prose, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 3)
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", 1)
    docs = frame(spark, prose * 5)
    got = sharding.shuffled(docs, bucket_bytes=4_000)[0].collect()
    assert sorted(r.position for r in got) == list(range(len(prose) * 5))
    assert sorted(r.doc_id for r in got) == list(range(1, len(prose) * 5 + 1))
