"""Tables of pages, chunking, progress documents, titles, headings and rolling terms against brute force and cases worked by hand."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from vellum.operators import chunking, latex, progress, tables, titles

BOX = "page_num long, x0 double, y0 double, x1 double, y1 double"


# ---- boxes ----------------------------------------------------------------------


def test_boxes_meet_once_each(spark):
    rng = random.Random(3)
    box = lambda: (rng.randrange(2), *(lambda x, y: (x, y, x + rng.choice([0, 5, 90, 700]), y + rng.choice([3, 64, 128])))(rng.randrange(-200, 600) * 1.0, rng.randrange(0, 500) * 1.0))
    a, b = [(i, *box()) for i in range(150)] + [(999, 0, -1e6, -1e6, 1e6, 1e6)], [(i, *box()) for i in range(120)] + [(998, 1, -1e6, 0.0, 1e6, 9e5)]
    frame = lambda rows: spark.createDataFrame(rows, f"id long, {BOX}")
    got = [(r.l.id, r.r.id) for r in tables.meeting(frame(a), frame(b)).collect()]
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and max(x[2], y[2]) < min(x[4], y[4]) and max(x[3], y[3]) < min(x[5], y[5])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_blocks_within_boxes_by_share(spark):
    blocks = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (2, 1, 7.0, 0.0, 17.0, 10.0), (3, 1, 7.1, 0.0, 17.1, 10.0), (4, 1, 0.0, 0.0, 0.5, 0.5), (5, 1, 0.0, 0.0, 0.6, 0.6), (6, 2, 0.0, 0.0, 1.0, 1.0), (7, 1, 3.0, 3.0, 3.0, 9.0)], f"block_idx long, {BOX}")
    rects = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], BOX)
    # block 2 has just 0.3 inside, which isn't over; an area under 1 counts as 1
    assert sorted(r.l.block_idx for r in tables.within(blocks, rects).collect()) == [1, 5]


def test_preserved_regions(spark):
    rows = [(True, True, True, True), (False, True, False, False), (False, False, True, False), (False, False, False, True), (False, False, False, False), (None, None, None, True)]
    df = spark.createDataFrame(rows, "c boolean, r boolean, t boolean, f boolean")
    assert [r[0] for r in df.select(tables.is_preserved(F.col("c"), F.col("r"), F.col("t"), F.col("f"))).collect()] == [False, True, True, True, False, True]


REAL = [
    ([["alpha", "beta"], ["gamma", "delta"]], [["x", "beta"], ["gamma", "delta"]], True),
    ([["alpha", "beta"], ["gamma", "delta"]], [["Alpha ", "beta"], ["gamma", ""]], False),  # no translation that differs
    ([["alpha", "beta"]], [["x", "y"]], False),
    ([["alpha"], ["beta"]], [["x"], ["y"]], False),
    ([["alpha", "beta"], ["", " "]], [["x", "y"], ["", ""]], False),  # one row with text
    ([], [], False),
    ([["1", "22", "333", "4444", "1", "1", "1"], ["1", "1", "1", "1", "1", "1", "55555"]], [["x"] * 7, ["x"] * 7], False),  # 13 of 14 are short: over 85 %
    ([["1", "22", "333", "4444", "1", "1"], ["1", "1", "1", "1", "1", "55555", "66666", "77777"]], [["x"] * 6, ["x"] * 8], True),  # 11 of 14: 79 %
    ([["1"] * 17 + ["55555"] * 3, [""]], [["x"] * 20, [""]], False),  # one row again
    ([["1"] * 10, ["1"] * 7 + ["55555"] * 3], [["x"] * 10, ["x"] * 10], True),  # 17 of 20: just 85 %, not over
    ([["(a)", "b", "(C)", "figure"], ["(d)", "words", "more words", "(e)"]], [["x"] * 4, ["y"] * 4], False),  # 5 of 8 labels: over 60 %
    ([["(a)", "b", "(C)", "figure", "plain"], ["words", "more words", "table", "row", "col"]], [["x"] * 5, ["y"] * 5], True),
    ([["(a)", "(b)", "(c)"], ["words", "words"]], [["x"] * 3, ["y"] * 2], True),  # 3 of 5: just 60 %
]


def test_tables_that_look_real(spark):
    df = spark.createDataFrame([(i, d, t) for i, (d, t, _) in enumerate(REAL)], "i int, d array<array<string>>, t array<array<string>>")
    got = {r.i: r.real for r in df.select("i", tables.looks_real(F.col("d"), F.col("t")).alias("real")).collect()}
    assert [got[i] for i in range(len(REAL))] == [want for _, _, want in REAL]


def test_cells_are_laid_out_and_translated(spark):
    rects = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0), (1, 2, 200.0, 0.0, 300.0, 100.0)], f"page_num long, table_idx int, {BOX[15:]}")
    rows = [
        (1, 1, 50.0, 3.0, 60.0, 13.0, "Second", "hai", True, False), (1, 2, 5.0, 0.0, 15.0, 10.0, " First  cell ", "một\nô", True, True),
        (1, 3, 5.0, 30.0, 15.0, 40.0, "Third one", "ba", False, False), (1, 4, 50.0, 30.0, 60.0, 40.0, "First cell", "khác", True, False), (1, 5, 210.0, 50.0, 220.0, 60.0, "First cell", "x", True, True),
        (1, 6, 250.0, 50.0, 260.0, 60.0, "lonely", None, True, True), (2, 7, 5.0, 0.0, 15.0, 10.0, "First cell", "y", True, True),
    ]
    blocks = spark.createDataFrame(rows, "page_num long, block_idx long, x0 double, y0 double, x1 double, y1 double, text string, translated string, translatable boolean, bold boolean")
    cells = tables.within(blocks, rects).select("page_num", F.col("r.table_idx").alias("table_idx"), "l.block_idx", "l.x0", "l.y0", "l.text")
    (only,) = tables.translated_tables(rects, tables.laid_out(cells), blocks).collect()  # the second table has one row
    assert (only.page_num, only.table_idx, only.header_bold) == (1, 1, True)
    assert only.data == [["First  cell", "Second"], ["Third one", "First cell"]]
    assert only.trans == [["khác", "hai"], ["Third one", "khác"]]  # of blocks with one text the last counts; what isn't translatable stays
    assert tables.translated_tables(rects.limit(0), tables.laid_out(cells), blocks).collect() == []


# ---- chunks -----------------------------------------------------------------------


def brute_markdown(text, most):
    sections, at, heading = [], 0, ""
    for m in re.finditer(r"^(#{1,6})\s+(.+)$", text, re.M):
        sections.append((heading, text[at : m.start()]))
        heading, at = m[0], m.end()
    sections.append((heading, text[at:]))
    out = []
    for heading, body in sections:
        body = body.strip()
        if not body:
            continue
        if len(body) <= most:
            out.append((heading, body))
            continue
        now = ""
        for p in re.split(r"\n\n+", body):
            if p.strip():
                if now and len(now) + len(p) + 2 > most:
                    out.append((heading, now.strip()))
                    now = ""
                now += p + "\n\n"
        if now.strip():
            out.append((heading, now.strip()))
    return out


def test_markdown_is_cut_at_headings_first(spark):
    rng = random.Random(8)
    pieces = ["# One", "## Two words", "####### seven", "#nospace", "text " * 5, "x" * 30, "", " ", "\n", "a\nb", "para. " * 8]
    texts = ["", "  \n", "# only heading", "no heading at all", "intro\n# H\nbody\n# Last", "#\n\nnext"] + ["\n\n".join(rng.choices(pieces, k=rng.randrange(1, 14))) for _ in range(60)]
    df = spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id long, text string")
    got = chunking.markdown_chunks(df, 60).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.section, r.chunk)):
        by.setdefault(r.doc_id, []).append((r.heading, r.text))
    assert by == {i: w for i, t in enumerate(texts) for w in [brute_markdown(t, 60)] if w}


def test_plans_close_at_titles_sentences_and_limits(spark):
    texts = ["a" * 60, "Results here", "b" * 70 + ".", "c" * 40, "d" * 90, "results", "", "e" * 10]
    blocks = spark.createDataFrame([(d, i, t) for d in (1, 2) for i, t in enumerate(texts)] + [(3, 0, None)], "doc_id long, piece long, text string")
    heads = spark.createDataFrame([(1, "Introduction"), (1, "RESULTS HERE AND THERE"), (2, "Results here")], "doc_id long, title string")
    got = {(r.doc_id, r.piece): r.chunk for r in chunking.planned_chunks(blocks, heads, 100, 150).collect()}
    # document 1: before the title at 60 > 50; 12 + 71 stays, then the sentence has ended and 40 more pass 100; 40 + 90 stays under 150; title again; the empty text is no title
    assert [got[1, i] for i in range(8)] == [0, 1, 1, 2, 2, 3, 3, 3]
    # document 2 has one section only: 60 + 12 + 71 stays under 150, the rest as before, 40 + 90 + 7 too; an empty text ends a sentence
    assert [got[2, i] for i in range(8)] == [0, 0, 0, 1, 1, 1, 1, 2] and got[3, 0] == 0


def test_latex_is_packed_by_blocks(spark):
    def brute(text, target):
        out, at = [], text.find("\\begin{document}")
        if at >= 0:
            at += len("\\begin{document}")
            out.append(text[:at])
        now = ""
        for b in latex.split_blocks(text[max(at, 0) :]):
            if now.strip() and len(now) + len(b) > target:
                out.append(now)
                now = ""
            now += b
        return (out + [now] if now.strip() else out) or [text]

    texts = ["", " \n ", "plain", "\\documentclass{x}\\begin{document}\n\\section{A}\ntext one\n\ntext two two\n\\begin{e}long long long\\end{e}\ntail\n\\end{document}", "\\begin{document}", "a\n\nbb\n\nccc\n\n" * 6]
    got = chunking.latex_chunks(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), 20).collect()
    by = {i: [r.text for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.chunk)] for i in range(len(texts))}
    assert by == {i: brute(t, 20) for i, t in enumerate(texts)}


# ---- progress documents --------------------------------------------------------------


def test_tables_out_of_progress_documents(spark):
    docs = [
        ("a_1", '{"status": "done", "translated_chunks": {"0": "x", "1": null}, "input_chunks:s:1/b.tex": {"0": "y"}, "input_chunks:c.tex": {}, "quality": {"score": 88.5}, "total_chunks": 3, "agentic": 1}'),
        ("b", '{"translated_chunks": ["no", "map"], "input_chunks:": {"k": "z"}, "total_chunks": null, "agentic": false, "arxiv_id": "q"}'), ("c", "{}"), ("d", "[1]"), ("e", "no json"), ("f", None), (None, '{"translated_chunks": {"0": "n"}}'),
    ]
    v = progress.read(spark.createDataFrame(docs, "job_id string, json string"))
    assert sorted(map(str, (tuple(r) for r in progress.chunk_rows(v).collect()))) == sorted(map(str, [("a_1", "0", "x"), ("a_1", "1", None), ("a_1", "input:s:1/b.tex:0", "y"), ("b", "input::k", "z"), (None, "0", "n")]))
    got = {r.job_id: tuple(r)[1:] for r in progress.job_rows(v).collect()}
    assert got["a_1"][:6] == ("latex", "a/1", "done", 3, 88.5, 3)
    assert got["b"] == ("latex", "q", "unknown", 1, None, None, None, None, False) and got["c"] == ("latex", "c", "unknown", 0, None, None, None, None, None)
    assert set(got) == {"a_1", "b", "c", None}


KEYS = [
    ("3", (None, 3)), ("input:a.tex:0", ("a.tex", 0)), ("input:sec:1/a.tex:12", ("sec:1/a.tex", 12)), ("input:a..b/c.tex:1", ("a..b/c.tex", 1)), ("input: :1", (" ", 1)),
    ("", None), ("x", None), ("-1", None), ("1.0", None), ("input:a.tex", None), ("input:a.tex:", None), ("input::1", None), ("input:/a.tex:1", None), ("input:a\\b:1", None), ("input:\\a:1", None),
    ("input:../a.tex:1", None), ("input:b/../a.tex:1", None), ("input:" + "a" * 248 + ":1", ("a" * 248, 1)), ("input:" + "a" * 249 + ":1", None), ("1" * 257, None), (None, None),
]


def test_chunk_keys(spark):
    df = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(KEYS)], "i int, key string")
    got = {r.i: r.p and tuple(r.p) for r in df.select("i", progress.key_parts(F.col("key")).alias("p")).collect()}
    assert [got[i] for i in range(len(KEYS))] == [want for _, want in KEYS]


def test_originals_of_chunks(spark):
    sources = [("j", "main.tex", True, 0, "m0"), ("j", "main.tex", True, 1, "m1"), ("j", "z/sec:1/a.tex", False, 0, "a0"), ("j", "b/a.tex", False, 0, "b0"), ("p", None, True, 0, "pdf0")]
    asked = [("j", "1", "latex"), ("j", "2", "latex"), ("j", "input:sec:1/a.tex:0", "latex"), ("j", "input:a.tex:0", "latex"), ("j", "input:c.tex:0", "latex"), ("j", "input:a.tex:9", "latex"), ("p", "0", "pdf_only"), ("p", "input:a.tex:0", "pdf_only"), ("q", "0", "latex"), ("j", "x", "latex"), ("j", "1", "latex")]
    got = progress.originals(spark.createDataFrame(asked, "job_id string, chunk_key string, source_type string"), spark.createDataFrame(sources, "job_id string, path string, is_main boolean, idx int, text string")).collect()
    want = [("m1", None), (None, "out_of_range"), ("a0", None), ("b0", None), (None, "no_file"), (None, "out_of_range"), ("pdf0", None), (None, "bad_key"), (None, "no_source"), (None, "bad_key"), ("m1", None)]
    assert sorted((*map(str, tuple(r)),) for r in got) == sorted((*map(str, a + w),) for a, w in zip(asked, want))


def test_recovery_writes_only_what_changes(spark, tmp_path):
    path = f"{tmp_path}/progress"
    rows = [(f"job{i}", "done" if i % 9 else "translating 1/5", i) for i in range(60)] + [("x", "resuming", 1), ("y", "interrupted", 1), ("z", None, 1), ("w", "translating", 2), ("v", "done_with_warnings", 3)]
    progress.write(spark.createDataFrame(rows, "job_id string, status string, n int"), path, 16)
    times = lambda: {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")}
    before = times()
    time.sleep(0.05)
    active = spark.createDataFrame([("w",), ("w",), ("gone",)], "job_id string")
    report = progress.recover(spark, path, active, "2026-01-01T00:00:00Z")
    assert report == {"scanned": 65, "active": 2, "interrupted": 8}
    got = {r.job_id: (r.status, r.n, r.interrupted_at) for r in spark.read.option("mergeSchema", "true").parquet(path).collect()}
    stale = {j for j, s, _ in rows if s and s.startswith(("translating", "resuming")) and j != "w"}
    assert got == {j: ("interrupted", n, "2026-01-01T00:00:00Z") if j in stale else (s, n, None) for j, s, n in rows}
    touched = {r.bucket for r in spark.read.parquet(path).where(F.col("job_id").isin(*stale)).select("bucket").collect()}
    after = times()
    same = {f for f in before if after.get(f) == before[f]}
    assert same == {f for f in before if int(re.search(r"bucket=(\d+)", f)[1]) not in touched} and same
    assert progress.recover(spark, path, active, "2027") == {"scanned": 65, "active": 2, "interrupted": 0} and times() == after


# ---- titles, headings, terms -----------------------------------------------------------


def test_titles_of_documents(spark):
    pages = [(d, 0, " text ", 1000.0, m) for d, m in [(1, "A proper title"), (2, "Untitled"), (3, "short"), (4, None), (5, None), (6, "Microsoft Word")]] + [(1, 1, "", 1000.0, None), (7, 0, None, 1000.0, None)]
    blocks = [
        (1, 0, 0.0, 30.0, "not this one"), (2, 0, 100.0, 20.0, "First line of it"), (2, 1, 120.0, 17.0, "second line"), (2, 2, 90.0, 16.9, "too small"), (2, 3, 550.0, 20.0, "too low down"), (2, 4, 80.0, 30.0, "tiny"),
        (3, 0, 10.0, 10.0, "ten points only"), (4, 0, 10.0, 12.0, "x" * 150), (4, 1, 20.0, 12.0, "y" * 150), (5, 0, 10.0, 0.0, "no size here"), (6, 0, 900.0, 20.0, "at the bottom"),
    ]
    got = {r.doc_id: r for r in titles.page_info(spark.createDataFrame(pages, "doc_id long, page_num int, text string, height double, meta_title string"), spark.createDataFrame(blocks, "doc_id long, block_idx long, y0 double, size double, text string")).collect()}
    assert {d: r.title for d, r in got.items()} == {1: "A proper title", 2: "First line of it second line", 3: "", 4: "x" * 150 + " " + "y" * 49, 5: "", 6: "", 7: ""}
    assert (got[1].page_count, got[1].has_text, got[1].total_chars) == (2, True, 4) and (got[7].has_text, got[7].total_chars) == (False, 0)


INLINE = [
    ("", ("same", "")), ("  \n% a comment with words", ("same", "  \n% a comment with words")), ("\\begin{x}\\label{some long name}$a$\\end{x}", ("same", "\\begin{x}\\label{some long name}$a$\\end{x}")),
    ("short txt", ("same", "short txt")), ("a plain line of text", None), (None, None),
    ("\\section{Introduction}\n\\section{Some other words}", ("same", "\\section{Introduction}\n\\section{Some other words}")),
    ("\\caption{Results} some plain words", None),
]


def test_inline_headings(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(INLINE)], "i int, c string")
    got = {r.i: tuple(r.r) for r in df.select("i", titles.inline(F.col("c")).alias("r")).collect()}
    assert [got[i] for i in range(len(INLINE))] == [w or (None, None) for _, w in INLINE]


def test_inline_dictionary(spark):
    """Commands leave no plain text, so the dictionary is reached only where an argument goes on in braces of its own."""
    chunk = "\\section*{Introduction}{%\n\n% gone\n  \\title{Related Work}   %\n\\emph{Unknown words}"
    lines = ["\\section*{Introduction}", "  \\title{Related Work}   %", "\\emph{Unknown words}"]
    df = spark.createDataFrame([(chunk,), ("\n".join(lines),)], "c string")
    a, b = (tuple(r.r) for r in df.select(titles.inline(F.col("c")).alias("r")).collect())
    assert a[0] in ("same", None) and b == ("same", "\n".join(lines))


def test_terms_belong_to_the_chunk_that_yields_them_first(spark):
    chunks = spark.createDataFrame([(d, i, "s" * (10 if i == 4 and d == 2 else 300)) for d in (1, 2) for i in range(10, 25)], "doc_id long, idx long, src string")
    said = {(1, 14): "tensor field → a\nknown term → b\nown term → c\ntensor field → d", (1, 19): "tensor field → x\nnew notion → e", (1, 20): "not looked at → f", (1, 24): "new notion → g", (2, 19): "tensor field → h"}
    answers = spark.createDataFrame([(*k, v) for k, v in said.items()], "doc_id long, idx long, raw string")
    got = titles.rolling_terms(chunks, answers, spark.createDataFrame([("known term",)], "en string"), spark.createDataFrame([(1, "own term"), (2, "new notion")], "doc_id long, en string")).collect()
    assert sorted(map(tuple, got)) == [(1, 14, "tensor field", "d", 1), (1, 19, "new notion", "e", 2), (2, 19, "tensor field", "h", 1)]
