"""The registered queries over the smallest tables, and the pipeline on odd ones."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import queries, store

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": ["doc_id", "fingerprint", "component_id"],
    "op2_lm_score": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op3_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"],
    "op4_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op5_html": ["page_id", "url", "text", "n_chars"],
    "op6_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op7_chat": ["conv_id", "n_turns", "n_copies", "text"],
    "op8_substrings": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op9_decontaminate": ["doc_id", "contaminated", "item_ids", "reworded"],
    "op10_warc": ["page_id", "record_id", "status", "canonical_url", "refers_to", "outcome", "body_md5", "date", "content_length", "etag", "n_headers"],
    "op11_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op12_fill_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op13_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
}


@pytest.fixture(scope="module")
def results(spark):
    return {name: (df := query(spark, SF)).columns and (df.columns, df.collect()) for name, query in queries.QUERIES.items()}


def test_every_row_of_every_table(spark, results):
    rows = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages")}
    assert {n: c for n, (c, _) in results.items()} == COLUMNS
    for n in ("op1_simhash", "op2_lm_score", "op3_quality_rules", "op4_sharding", "op8_substrings", "op9_decontaminate", "op12_fill_middle", "op13_token_counts"):
        assert len(results[n][1]) == rows["documents"]
    assert len(results["op5_html"][1]) == rows["pages"] and len(results["op10_warc"][1]) == 2 * rows["pages"]


def test_digests(spark, results):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in results["op1_simhash"][1]:
        assert len(r.fingerprint) == 16 and int(r.fingerprint, 16) >= 0 and r.fingerprint == r.fingerprint.lower() and r.component_id <= r.doc_id
    shards = defaultdict(list)
    for r in results["op4_sharding"][1]:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
        shards[r.shard].append(r.slot)
    sizes = [len(shards[k]) for k in range(24)]
    assert set(shards) <= set(range(24)) and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in shards.values())
    sequences, starts = defaultdict(list), defaultdict(list)
    for r in results["op6_packing"][1]:
        sequences[r.sequence_id].append((r.offset, r.length))
        starts[r.doc_id].append((r.piece, r.start, r.length))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert set(starts) == set(texts) and all([p for p, _, _ in sorted(v)] == list(range(len(v))) for v in starts.values())
    for r in results["op5_html"][1]:
        assert r.n_chars == len(r.text)
    assert {r.held_out for r in results["op2_lm_score"][1]} == {True, False} and len({r.train_tokens for r in results["op2_lm_score"][1]}) == 1


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_repeated_ids_nulls_and_more_columns(spark, tmp_path):
    rng = np.random.default_rng(9)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5_000, n))
    a, b, c = word(120), word(140), word(90)
    rows = [(1, a), (1, a), (2, b), (None, c), (3, None), (4, ""), (5, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    docs = docs.withColumns({"n_words": F.lit(-1), "spans": F.lit("own"), "item_id": F.col("doc_id"), "component_id": F.lit("x"), "fail_bits": F.lit(2.5)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, word(30)), (1, word(30)), (None, b)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns[:5] == docs.columns[:5]
    assert sorted((r.doc_id or 0, r.text) for r in now.collect()) == sorted([(0, c), (1, a), (1, a), (2, b)])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 1, 1, 2] and len({(r.sequence_id, r.offset) for r in out}) == 4


def test_written_tables_can_be_cleared(spark):
    kept = store.written(spark.range(3), "kept")
    gone = store.written(spark.range(3), "gone")
    store.remove(gone)
    assert kept.count() == 3
    table = store.bucketed(spark.range(10), "id", "buckets")
    assert table.count() == 10 and not [t for t in spark.catalog.listTables() if t.name.startswith("buckets")]
