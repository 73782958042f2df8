"""Literal cases, worked out by hand, of page geometry, runs, sinks, answers and LaTeX repairs."""

import datetime
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import diagnostics, geometry, latex, layout, retrieval, runs, scoring, state
from vellum.plans import responses
from vellum.sources import files, sinks

BOX = "page_num long, block_idx int, x0 double, y0 double, x1 double, y1 double"


def one(spark, *columns):
    got = spark.range(1).select(*columns).first()
    return got[0] if len(columns) == 1 else tuple(got)


def lines(*spans):
    return F.array(*(F.struct(F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("x1")) for a, b in spans)) if spans else F.array().cast("array<struct<x0:double,x1:double>>")


@pytest.mark.parametrize(
    ("spans", "box", "want"),
    [
        ([], (50, 550), (0, 0.0)),
        ([(200, 402)], (200, 402), (1, 0.0)),  # margins 200 and 198 of 600
        ([(50, 250)], (50, 250), (0, 0.0)),
        ([(10, 590)], (10, 590), (0, 0.0)),
        ([(70, 550), (50, 549), (50, 551), (50, 200)], (50, 550), (3, 20.0)),
        ([(50, 550), (51, 549), (50, 300)], (50, 550), (3, 0.0)),
        ([(100, 500), (150, 450), (200, 400)], (100, 500), (1, 0.0)),
        ([(100, 550), (200, 550), (300, 549)], (100, 550), (2, 0.0)),
        ([(60, 550), (50, 400)], (50, 550), (0, 10.0)),
        ([(52, 550), (50, 400)], (50, 550), (0, 0.0)),
    ],
)
def test_block_formats(spark, spans, box, want):
    got = one(spark, geometry.block_format(lines(*spans), F.lit(float(box[0])), F.lit(float(box[1])), F.lit(600.0)))
    assert tuple(got) == want


def test_columns_of_blocks(spark):
    two = F.array(*(F.struct(F.lit(a).alias("l"), F.lit(b).alias("r")) for a, b in ((50.0, 290.0), (310.0, 550.0))))
    got = one(spark, *(geometry.column_of(F.lit(float(a)), F.lit(float(b)), two) for a, b in ((60, 200), (280, 320), (320, 500), (560, 700), (0, 40))))
    assert got == (0, 0, 1, 1, 0)  # a middle of 300 lies within 10 points of both
    assert one(spark, geometry.column_of(F.lit(900.0), F.lit(950.0), F.slice(two, 1, 1))) == 0


def test_neighbours(spark):
    rows = [(1, 0, 50.0, 100.0, 200.0, 120.0), (1, 1, 50.0, 120.5, 200.0, 130.0), (1, 2, 60.0, 140.0, 200.0, 150.0), (1, 3, 300.0, 125.0, 400.0, 135.0), (2, 0, 50.0, 10.0, 90.0, 20.0)]
    b = spark.createDataFrame(rows, BOX)
    room = {(r.page_num, r.block_idx): r.max_y for r in geometry.room_below(b).collect()}
    assert room == {(1, 0): 119.0, (1, 1): 138.5, (1, 2): 170.0, (1, 3): 155.0, (2, 0): 40.0}
    nxt = {(r.page_num, r.block_idx): r.next_y for r in geometry.next_below(b.withColumn("col", (F.col("x0") > 250).cast("int")), 800.0).collect()}
    assert nxt == {(1, 0): 138.0, (1, 1): 138.0, (1, 2): 780.0, (1, 3): 780.0, (2, 0): 780.0}


def boxes(*rows):
    return F.array(*(F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), r, strict=True))) for r in rows))


def test_obstacles_and_rects(spark):
    o = boxes((0, 200, 600, 240), (0, 100, 600, 150), (0, 149, 600, 190), (700, 0, 800, 900))
    assert one(spark, *(geometry.past_obstacles(F.lit(float(y)), F.lit(50.0), F.lit(550.0), o) for y in (90, 98, 120, 195, 240, 300))) == (90.0, 192.0, 192.0, 195.0, 240.0, 300.0)
    assert one(spark, geometry.past_obstacles(F.lit(199.0), F.lit(50.0), F.lit(550.0), o)) == 242.0
    kept = one(spark, geometry.merged_rects(boxes((0, 0, 100, 100)), boxes((10, 10, 50, 50), (80, 80, 200, 200), (90, 90, 190, 190), (300, 0, 310, 10))))
    assert [tuple(r) for r in kept] == [(0.0, 0.0, 100.0, 100.0), (80.0, 80.0, 200.0, 200.0), (300.0, 0.0, 310.0, 10.0)]


def test_ruled_tables(spark):
    level = [(1, 50.0, y, 250.0, y) for y in (100.0, 130.0, 160.0, 400.0)] + [(1, 50.0, 115.0, 90.0, 115.0), (1, 50.0, 90.0, 60.0, 90.0)]
    upright = [(1, x, 98.0, x, 162.0) for x in (50.0, 250.0)] + [(1, 500.0, 0.0, 500.0, 900.0)]
    rows = level + upright + [(2, *r[1:]) for r in level] + [(2, 50.0, 98.0, 50.0, 162.0)]
    got = [tuple(r) for r in geometry.ruled_tables(spark.createDataFrame(rows, "page_num long, x0 double, y0 double, x1 double, y1 double")).collect()]
    assert got == [(1, 50.0, 100.0, 250.0, 160.0)]


def test_diagrams(spark):
    near = [(1, i, 50.0 * i, 10.0, 50.0 * i + 40, 100.0) for i in range(4)]  # 10 points apart
    far = [(1, 9, 900.0, 10.0, 940.0, 60.0), (1, 10, 0.0, 20.0, 1.0, 50.0)]
    small = [(2, i, 5.0 * i, 0.0, 5.0 * i + 4, 4.0) for i in range(5)] + [(3, i, 50.0 * i, 10.0, 50.0 * i + 40, 89.9) for i in range(4)] + [(4, i, 71.0 * i, 10.0, 71.0 * i + 40, 100.0) for i in range(4)]  # too small, too low, too far apart
    got = [tuple(r) for r in geometry.diagrams(spark.createDataFrame(near + far + small, BOX)).collect()]
    assert got == [(1, -4.0, 6.0, 194.0, 104.0)]
    colour = lambda *x: F.array(*map(F.lit, x))
    none = F.lit(None).cast("array<double>")
    assert one(spark, *(geometry.is_coloured(s, f) for s, f in ((colour(0.9, 0.1, 0.1), none), (colour(0.2, 0.2, 0.2), none), (none, colour(1.0, 1.0, 1.0)), (none, colour(1.0, 0.9, 1.0)), (none, none)))) == (True, False, False, True, False)


PROGRESS = "job_id string, status string, failed_chunks array<int>, retry_count int, title string, page_count int, base_job_id string"


def test_status_and_crashes(spark):
    rows = [("a", "translating 3/8", [], 0, "T", 1, None), ("b", "done", None, None, "", 1, None), ("c", None, [1, 2, 3], 0, None, 1, None), ("d", "retrying x", [], 0, None, 1, None), ("e", "translating 1/0", [5], 2, None, 1, None)]
    p = spark.createDataFrame(rows, PROGRESS)
    view = {r.job_id: tuple(r)[1:] for r in runs.status_view(p).collect()}
    assert view["a"] == ("translating 3/8", 3, 8, 38, None, "T") and view["b"] == ("done", None, None, 100, None, None)
    assert view["c"] == ("pending", None, None, None, 3, None) and view["e"] == ("translating 1/0", 1, 0, 0, 1, None)
    crash = {r.job_id: (r.severity, r.confidence, r.affected) for r in runs.crashed(p).collect()}
    assert crash == {"c": ("critical", 0.85, [1, 2, 3]), "d": ("warning", 0.55, []), "e": ("warning", 0.85, [5])}
    assert [tuple(x) for x in one(spark, *(runs.counters(F.lit(s), F.lit(4)) for s in ("translating 3/8", "translating x", "done")))] == [(3, 8), (4, 0), (4, 0)]


def test_earlier_runs(spark):
    rows = [("pdf_a", "s", [], 0, " My Title", 9, None), ("pdf_a_1", "s", [], 0, "x", 9, None), ("pdf_ab", "s", [], 0, "MY title", 9, None), ("q", "s", [], 0, "z", 1, "pdf_a"), ("r", "s", [], 0, "my title", 8, None), ("s", "s", [], 0, None, None, None)]
    up = spark.createDataFrame([(1, "pdf_a", "none", 0), (2, "", "my title ", 9), (3, "", "", 9), (4, None, "my title", None)], "upload int, base_job_id string, title string, page_count int")
    got = sorted(tuple(r) for r in runs.earlier_runs(up, spark.createDataFrame(rows, PROGRESS)).collect())
    assert got == [(1, "pdf_a"), (1, "pdf_a_1"), (1, "q"), (2, "pdf_a"), (2, "pdf_ab")]


def test_roots_locations_imports_and_columns(spark):
    jobs = lambda *r: spark.createDataFrame(list(r), "job_id string, owner string, path string")
    own, old = jobs(("a", "u", "/u/a")), jobs(("a", None, "/a"), ("b", None, "/b"))
    assert sorted((r.job_id, r.path) for r in runs.visible([own, old]).collect()) == [("a", "/u/a"), ("b", "/b")]
    asked = spark.createDataFrame([("a", "u", False), ("a", "v", False), ("b", "u", True), ("b", "u", False), ("c", "u", True)], "job_id string, owner string, allow_legacy boolean")
    assert sorted((r.job_id, r.owner, r.allow_legacy, r.path) for r in runs.located(asked, own, old).collect()) == [("a", "u", False, "/u/a"), ("a", "v", False, None), ("b", "u", False, None), ("b", "u", True, "/b"), ("c", "u", True, None)]
    table = spark.createDataFrame([("a", "me")], "job_id string, owner string")
    assert sorted(map(tuple, runs.imported(table, spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "x")], "job_id string, status string"), "root").collect())) == [("a", "me"), ("b", "root")]
    wide = runs.with_columns(table, {"owner": "string", "notes": "string", "n": "int"})
    assert wide.dtypes[2:] == [("notes", "string"), ("n", "int")] and wide.first().notes is None


def test_recovery_and_synthesis(spark):
    state = spark.createDataFrame([("a", 1, "x")], "job_id string, chunk int, text string")
    disk = spark.createDataFrame([("a", 1, "other"), ("a", 2, "y"), ("a", 3, "  "), ("a", 4, None)], "job_id string, chunk int, text string")
    assert sorted(tuple(r) for r in runs.reconciled(state, disk).collect()) == [("a", 1, "x", "state"), ("a", 2, "y", "disk")]
    c = spark.createDataFrame([("a", i, f"t{i}") for i in range(5)], "job_id string, chunk int, mt string")
    s = spark.createDataFrame([("a", 0, "consensus", False, "f0"), ("a", 1, "consensus", True, "f1"), ("a", 2, "mild", False, "f2"), ("a", 3, "mild", True, "")], "job_id string, chunk int, verdict string, synthesis_used boolean, final string")
    assert [(r.mt, r.changed) for r in runs.synthesised(c, s).orderBy("chunk").collect()] == [("t0", False), ("f1", True), ("f2", True), ("t3", False), ("t4", False)]


def test_memory(spark):
    rows = [(1, 0, "x", "Chúng ta xem bài viết"), (1, 1, "x", "chúng tôi có kết quả"), (1, 2, "x", "chúng ta và chúng tôi"), (2, 0, "x", "không")]
    c = spark.createDataFrame(rows, "conv_id long, idx long, src string, mt string")
    assert {(r.key, r.phrase) for r in runs.style_profile(c).collect()} == {("pronoun_we", "chúng tôi"), ("paper", "bài viết"), ("result", "kết quả")}
    d = spark.createDataFrame([(1, 3, ["a"]), (1, 1, []), (2, 0, None)], "conv_id long, idx long, key_terms array<string>")
    got = {r.conv_id: (r.size, r.chunk_indexes, r.key_terms) for r in runs.memory_rollup(d).collect()}
    assert got == {1: (2, [1, 3], {"3": ["a"]}), 2: (1, [0], {})}
    long_ = spark.createDataFrame([(1, i * 10, "s" * (300 if i != 9 else 299), "") for i in range(12)], "conv_id long, idx long, src string, mt string")
    assert [r.idx for r in runs.discoveries(long_).collect()] == [40]
    log = spark.createDataFrame([("a", "m1", True, 1), ("a", "m2", True, 2), ("a", "m3", False, 3), ("b", "m", False, 1)], "job_id string, model string, ok boolean, seq int")
    assert [tuple(r) for r in runs.style_owner(log).collect()] == [("a", "m2")]


def test_critiques_and_log_texts(spark):
    e = spark.createDataFrame([(1, 2, 1, "accuracy", "minor"), (1, 2, 0, "fluency", "major"), (1, 0, 0, "style", "minor")], "conv_id long, idx long, pos int, category string, severity string")
    assert runs.critique_text(e).first().text == "Block [1]:\n- minor style\nBlock [3]:\n- major fluency\n- minor accuracy"
    assert one(spark, F.length(runs.for_log(F.lit("x" * 4_000))), F.substring(runs.for_log(F.lit("x" * 5_000)), 4_001, 50)) == (4_000, "...[truncated 5000 chars]")


def test_sinks(spark, tmp_path):
    at = datetime.datetime(2024, 1, 2, 3, 4, 5, 678)
    ev = spark.createDataFrame([("r", "a", at, "p", "z", "d" * 5_000), ("r", "a", at, "p", "b", "1"), ("r", "c", at, "p", "b", None)], "run_id string, job_id string, ts timestamp, phase string, event_type string, data string")
    for _ in range(2):
        sinks.log(ev, f"{tmp_path}/log")
    got = spark.read.json(f"{tmp_path}/log")
    assert got.count() == 6 and {(r.job_id, r.seq, r.event_type) for r in got.collect()} == {("a", 1, "b"), ("a", 2, "z"), ("a", 3, "b"), ("a", 4, "z"), ("c", 1, "b"), ("c", 2, "b")} and got.first().ts == "2024-01-02T03:04:05.000678Z"
    sinks.raw_responses(spark.createDataFrame([("a", 1, 2, "k", "t")], "job_id string, chunk_idx int, attempt int, kind string, text string"), f"{tmp_path}/raw")
    assert spark.read.parquet(f"{tmp_path}/raw").where("job_id = 'a' and chunk_idx = 1").first().text == "t"
    sinks.metrics(spark.createDataFrame([("a", 1.23456789), ("b", None)], "name string, x double"), f"{tmp_path}/m")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/m/csv").collect() if r.value != "name,x") == ["a,1.2346", "b,"]
    sinks.run_record(spark, "a", f"{tmp_path}/env", {"k": "v"})
    assert json.loads(spark.read.json(f"{tmp_path}/env").first().extra) == {"k": "v"}
    sinks.put(f"{tmp_path}/c", spark.createDataFrame([("k", "old")], "key string, value string"), 60)
    sinks.put(f"{tmp_path}/c", spark.createDataFrame([("k", "new"), ("gone", "x")], "key string, value string"), 60)
    assert {r.key: r.value for r in sinks.live(spark, f"{tmp_path}/c").collect()} == {"k": "new", "gone": "x"}
    assert sinks.live(spark, f"{tmp_path}/c", F.current_timestamp() + F.expr("interval 2 minutes")).count() == 0


def test_json_answers(spark):
    said = ['{"a": 1}', 'x ```json\n{"a": 2}\n``` y', "```\n{\"a\": 3}\n```", 'so {"a": 4} it is', "no", "{broken", ""]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").orderBy("i").select(F.try_variant_get(responses.json_value(F.col("t")), "$.a", "int")).collect()]
    assert got == [1, 2, 3, 4, None, None, None]
    raw = 'here {"errors": [{"category": "style", "severity": "major"}, null, {"description": "d"}]} end'
    faults = one(spark, responses.critic_faults(F.lit(raw)))
    assert [(f.category, f.severity, f.description, f.suggestion) for f in faults] == [("style", "major", "", ""), ("accuracy", "minor", "d", "")]
    assert one(spark, responses.critic_faults(F.lit("none"))) == [] and one(spark, responses.critic_faults(F.lit("{x}"))) == []


def test_merged_faults(spark):
    found = spark.createDataFrame([(1, 0, 0, "accuracy", "minor"), (3, 0, 0, "accuracy", "critical")], "conv_id long, idx long, pos int, category string, severity string")
    raw = '{"errors": [{}, {"category": "style"}, {"category": "style"}]}'
    answers = spark.createDataFrame([(i, 0, raw) for i in (1, 2, 3)], "conv_id long, idx long, raw string")
    texts = spark.createDataFrame([(1, 0, "w " * 40), (2, 0, "w " * 39), (3, 0, "w " * 50)], "conv_id long, idx long, src string")
    got = sorted(tuple(r)[:1] + tuple(r)[2:] for r in responses.merged_faults(found, answers, texts).collect())
    assert got == [(1, "accuracy", "minor", "rules"), (1, "style", "minor", "answer"), (3, "accuracy", "critical", "rules")]


def test_semantic_bands(spark):
    assert one(spark, *(scoring.f1_band(F.lit(x)) for x in (0.92, 0.919, 0.87, 0.8, 0.7, 0.69))) == ("excellent", "good", "good", "fair", "middling", "low")
    rows = spark.createDataFrame([(1, 0, "s", "t"), (2, 0, "s", " "), (3, 0, "s", "t")], "conv_id long, idx long, src string, mt string")
    s = spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.9)], "conv_id long, idx long, f1 double")
    assert [tuple(r) for r in scoring.semantic_scores(rows, s).collect()] == [(1, 0, 0.9, "good")]


def test_latex_repairs(spark):
    fix = lambda t: one(spark, latex.repaired(F.lit(t)))
    assert fix("% note\\begin{table}x\\end{table}") == "% note\n\n\\begin{table}x\\end{table}"
    assert fix("Done.\\begin{quote}x\\end{quote}Next") == "Done.\n\n\\begin{quote}x\\end{quote}\n\nNext"
    assert fix("\\subsection{X} \\paragraph{Y} end. \\section{Z}") == "\\subsection{X}\n\n\\paragraph{Y} end.\n\n\\section{Z}"
    assert fix("\\begin{equation*}\n\\paragraph{P} text") == "\n\n\\paragraph{P} text"  # no end, so the beginning goes
    assert fix("\\begin{equation}\n\\section{S}\n\\end{equation}") == "\\section{S}\n\\end{equation}"
    mend = latex.mended_environments
    assert mend("\\begin{center}\n% \\end{center}") == "%\\begin{center}\n% \\end{center}"
    assert mend("% \\begin{center}\n\\end{center}") == "% \\begin{center}\n%\\end{center}"
    assert mend("a \\begin{figure}[h] b\n\\begin{itemize}\\end{itemize}") == "a  b\n\\begin{itemize}\\end{itemize}"
    assert mend("% \\begin{figure}\n\\begin{quote}") == "% \\begin{figure}\n\\begin{quote}"
    assert latex.math_spans("a $$x\ny$$ b $z$ $ c") == [("display", "x\ny", 2, 9), ("inline", "z", 12, 15)]
    assert latex.inline_segments("a [[#1]]b[[/#1]] c [[#2]]d [[/#3]] e") == [("a ", None), ("b", 1), (" c ", None), ("d  e", None)]
    assert latex.inline_segments("") == [] and latex.inline_segments("[[#1]][[/#1]]") == []


def test_retrieval_in_many_blocks(spark, monkeypatch):
    """The same in one block and in many, and with few products at once; against brute force."""
    rng = np.random.default_rng(3)
    vecs = rng.normal(0, 1, (240, 6)).round(2)
    vecs[7] = 0
    vecs[100], vecs[13] = vecs[20], vecs[20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>")
    unit = vecs.astype(np.float32).astype(float)
    unit = unit / np.maximum(np.sqrt((unit * unit).sum(1, keepdims=True)), 1e-300)
    want = set()
    for q in range(0, 240, 20):
        s = unit @ unit[q]
        best = sorted((i for i in range(240) if i != q), key=lambda i: (-round(s[i], 9), i))[:5]
        want |= {(q, i, k + 1) for k, i in enumerate(best)}
    words = [f"t{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, int(rng.integers(0, 30))))) for i in range(150)], "doc_id long, text string")
    texts = set(map(tuple, retrieval.tfidf_top(docs, 3, 10).collect()))
    for size, open_ in ((16 << 20, 1 << 20), (200, 50)):
        monkeypatch.setattr(retrieval, "QUERY_BYTES", size)
        monkeypatch.setattr(retrieval, "TABLE_BYTES", size * 4)
        monkeypatch.setattr(retrieval, "OPEN", open_)
        assert {(r.query_id, r.vec_id, r.rank) for r in retrieval.embedding_top(df, 5, 20).collect()} == want
        assert set(map(tuple, retrieval.tfidf_top(docs, 3, 10).collect())) == texts and len(texts) >= 40
    assert retrieval.embedding_top(df.limit(0)).count() == 0 and retrieval.tfidf_top(docs.limit(0)).count() == 0


def test_one_chunk_counts_once_for_each_cause(spark):
    rows = spark.createDataFrame([(1, 0, "S" * 99 + ".", ""), (1, 1, "S" * 99 + ".", "t")], "conv_id long, idx long, src string, mt string")
    failed = spark.createDataFrame([(1, 0)], "conv_id long, idx long")
    got = {r.cause: (r.affected, r.severity, r.confidence) for r in diagnostics.findings(rows, failed).collect()}
    assert got == {"EMPTY_TRANSLATION": ([0, 1], "critical", 0.72), "TRUNCATED_RESPONSE": ([1], "warning", 0.63)}


def test_files(spark, tmp_path):
    for where, text in (("users/u/jobs/pdf_a", '{"n": 1}'), ("jobs/pdf_b", '{"n": 2}'), ("jobs/other", "{}"), ("notes", "{}")):
        (tmp_path / "w" / where).mkdir(parents=True)
        (tmp_path / "w" / where / "progress.json").write_text(text)
    assert sorted(json.loads(r.json).get("n", 0) for r in files.progress_files(spark, f"{tmp_path}/w").collect()) == [0, 1, 2]
    assert {r.path.split("/")[-2] for r in files.recent_progress(spark, f"{tmp_path}/w", 5).collect()} == {"pdf_a", "pdf_b"}
    assert files.recent_progress(spark, f"{tmp_path}/w", 1).count() == 1
    assert [json.loads(r.json) for r in files.progress_of(spark, f"{tmp_path}/w", "pdf_a").collect()] == [{"n": 1}] and files.progress_of(spark, f"{tmp_path}/w", ".*").count() == 0
    (tmp_path / "packs").mkdir()
    (tmp_path / "packs" / "x.json").write_text('{"name": "X", "terms": {"a": "b"}}')
    (tmp_path / "packs" / "y.json").write_text('{"id": "why", "name": "Y"}')
    found = files.packs(spark, f"{tmp_path}/packs")
    assert [(r.id, r.term_count) for r in found.collect()] == [("x", 1)]
    assert files.pack(found, "x").first().name == "X" and files.pack(found, "../x").count() == 0 and files.pack(found, "z").count() == 0
    (tmp_path / "accounts.txt").write_text("# no\n a@b.c \n\na@b.c\nd@e.f\n")
    assert sorted(r.line for r in files.lines(spark, f"{tmp_path}/accounts.txt").collect()) == ["a@b.c", "d@e.f"]
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert [tuple(r) for r in files.csv_rows(spark, f"{tmp_path}/t.csv").collect()] == [("1", "x")]
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>')
    assert [(r.block_idx, r.text) for r in files.docx_paragraphs(spark, f"{tmp_path}/d.docx").collect()] == [(0, "One two"), (2, "three")]


def test_answers_and_small_rules(spark):
    blocks = spark.createDataFrame([(1, 1, ""), (1, 2, "kept"), (1, 3, None), (2, 1, "")], "doc_id long, index int, mt string")
    replies = spark.createDataFrame([(1, "[1] one\n[2] two\n[3] three")], "doc_id long, text string")
    assert {(r.doc_id, r["index"]): r.mt for r in responses.filled(blocks, replies).collect()} == {(1, 1): "one", (1, 2): "kept", (1, 3): "three", (2, 1): ""}
    fixes = spark.createDataFrame([(1, 1, "better"), (1, 2, " "), (1, 3, "bad")], "doc_id long, index int, fix string")
    texts = spark.createDataFrame([(1, i, "old") for i in (1, 2, 3, 4)], "doc_id long, index int, mt string")
    assert [r.mt for r in responses.guarded_fix(texts, fixes, lambda f: f != "bad").orderBy("index").collect()] == ["better", "old", "old", "old"]
    assert one(spark, responses.all_fenced(F.lit("a ```x\none``` b ```\ntwo\n``` c")), responses.without_tags(F.lit("<b>x</b> <i>y</i><p>"))) == ("one\ntwo\n", "x y<p>")
    assert one(spark, *(state.is_terminal(F.lit(s)) for s in ("done", "error: x", "translating 1/2", "cancelled"))) == (True, True, False, True)
    cache = spark.createDataFrame([("a", 5.0), ("b", 1.0)], "key string, expires_at double")
    assert [r.key for r in state.cache_read(cache, 2.0).collect()] == ["a"]
    span = lambda text, y, size: F.struct(F.lit(text).alias("text"), F.lit(y).alias("y"), F.lit(size).alias("size"))
    got = one(spark, *(layout.is_geometric_math(span(*s), F.lit(10.0), F.lit(10.0)) for s in (("2", 7.0, 10.0), ("2", 10.0, 8.0), ("2", 10.0, 10.0), ("a long text here", 7.0, 10.0))))
    assert got == (False, False, False, False)  # footnote marks and prose
    assert one(spark, *(layout.is_narrow_vertical(*map(F.lit, b)) for b in ((0.0, 0.0, 20.0, 100.0), (0.0, 0.0, 50.0, 900.0), (0.0, 0.0, 20.0, 50.0)))) == (True, False, True)
    page = spark.createDataFrame([(1, i, *b) for i, b in enumerate([(50.0, 0.0, 280.0, 9.0), (60.0, 20.0, 290.0, 29.0), (310.0, 0.0, 550.0, 9.0), (320.0, 20.0, 550.0, 29.0)])], BOX)
    assert [tuple(c) for c in layout.columns(page, 600.0).first()["columns"]] == [(50.0, 290.0), (310.0, 550.0)]
    boxes_ = spark.createDataFrame([(1, 1, 0, 2, 1.0, 1.0, 2.0, 2.0), (1, 0, 1, 1, 0.0, 0.0, 1.0, 1.0), (1, 0, 0, 1, 5.0, 0.0, 6.0, 1.0)], "doc_id long, chunk int, block_idx int, page_num int, x0 double, y0 double, x1 double, y1 double")
    assert [[b.x0 for b in c] for c in runs.block_map(boxes_).first().chunks] == [[5.0, 0.0], [1.0]]
