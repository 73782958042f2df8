"""Rules against cases worked by hand from what they are to do."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import advice, convert, glossary, layout, masking, progress, runs, scoring, segments, state
from vellum.plans import responses
from vellum.sources import files, sinks


@pytest.fixture
def one(spark):
    return lambda *c: (lambda r: r[0] if len(r) == 1 else tuple(r))(spark.range(1).select(*c).first())


L = F.lit


def test_chat_remarks(one):
    assert one(responses.strip_artefacts(L("a\nNote: x\nb\n  Bạn có muốn thêm?\nCopy code\n\n  \n"))) == "a\nb\nCopy code"
    assert one(responses.strip_artefacts(L("IF YOU want\nLưu ý: c"))) == "" and one(responses.strip_artefacts(L("a note: stays"))) == "a note: stays"


def test_text_of_answers(one):
    of = lambda t: one(responses.text_of_answer(L(t)))
    assert of("say\n```text\n một \nhai\n```\nmore") == "một \nhai" and of("```\nx\n```") == "x" and of("") == ""
    assert of("[1] (max ~120 chars) một\n[2] (table cell, max ~ 9 char) hai") == "[1] một\n[2] hai"
    assert of("một\n\nWould you like more?\nhai") == "một" and of("một\n=== QUY TẮC\nhai") == "một" and of("một\nDịch các đoạn văn bản sau sang tiếng Việt: x") == "một"
    assert of("```latex\nx\n```") == "```latex\nx\n```"


def test_latex_of_answers(one):
    of = lambda t: one(responses.latex_of_answer(L(t)))
    assert of("a\n```latex\n one \n```\nb\n```\ntwo\n```") == "one\ntwo"
    assert of("Code snippet\n\\section{A}\nx") == "\\section{A}\nx" and of("code snippet") == "code snippet"
    assert of("x\nNote: y\nz") == "x" and of("x\nIf you\nz") == "x\nIf you\nz"  # a shorter list than for text
    assert of("x\n=== BẢNG THUẬT NGỮ\ny") == "x" and of("x\nend. Dịch nội dung LaTeX sau sang tiếng Việt. y\nz") == "x\nend." and of("Dịch nội dung LaTeX sau sang tiếng Việt") == ""


def test_only_a_fence_round_the_whole_answer_goes(one):
    of = lambda t: one(responses.fenced(L(t)))
    assert of("```json\n[1]\n```") == "[1]" and of("  ```\na\n\nb\n  ``` ") == "a\n\nb"
    assert of("x ```tex\ny\n``` z") == "x ```tex\ny\n``` z" and of("```a\nb") == "```a\nb" and of("```") == "```" and of("```\n```") == "" and one(responses.fenced(L(None).cast("string"))) == ""


def test_translations_of_blocks(one):
    of = lambda t, *src: one(responses.translated_blocks(L(t), F.array(*map(L, src))))
    assert of("[1] một\n[2] hai", "a", "b") == ["một", "hai"]
    assert of("[1] một\nsee\n[7] there\n[2] hai", "a", "b") == ["một\nsee [7] there", "hai"]  # a citation, not a block
    assert of("intro\n[2] hai [1] inside\nNote: x", "a", "b", "c") == ["a", "hai [1] inside", "c"]  # what isn't answered keeps its source
    assert of("[2] hai\n[1] một\n[9] cited", "a", "b") == ["một", "hai [9] cited"]  # it goes on the highest so far
    assert of("[1] x\n[1] y", "a") == ["y"] and of("[1] \n[2] b", "a", "c") == ["[2] b", "c"]  # white space after a number belongs to it, so the next is inside a line
    assert of("Plaintext một hai", "a") == ["một hai"] and of("no number", "a", "b") == ["a", "b"] and of("[9] lost", "a") == ["[9] lost"]
    assert of("", "a") == ["a"]


def test_judged_scores_are_taken_as_they_are(spark):
    raw = '[{"index": 1, "score": 140}, {"index": 2, "score": 50, "errors": [{"category": "accuracy", "severity": "minor"}]}, {"index": 3, "score": -3.25}, {"index": 3}, {"index": 4, "score": 1}, {"index": 4, "score": 2}]'
    rows = spark.createDataFrame([(1, raw, [1, 2, 3, 4, 5])], "id long, raw string, asked array<int>")
    got = {r["index"]: r["score"] for r in responses.judge_scores(rows, lambda c, s: F.lit(1.26)).collect()}
    assert got == {1: 140.0, 2: 98.7, 3: -3.25, 4: 2.0, 5: None}
    assert scoring.error_weight is not None


def test_model_preferences(one):
    of = lambda t: one(responses.model_preference(L(t).cast("string")))
    assert of('["Gemini", " GROK ", "zzz", "gemini"]') == ["gemini", "grok"] and of("copilot; ChatGPT,chatgpt x") == ["copilot", "chatgpt"]
    for nothing in (None, "", "  ", "[]", "zzz", "5", '{"a": 1}', '"gemini"'):
        assert of(nothing) == ["gemini", "chatgpt"]
    assert one(responses.execution_order(F.array(L("grok")))) == ["grok", "gemini", "chatgpt", "aistudio", "deepseek", "copilot"]


@pytest.mark.parametrize(
    "text, reason",
    [("", "empty"), (" \n", "empty"), (None, "empty"), ("http://a.b/c www.x.y me@a.bc doi: 10.1/x", "url_only"), ("10.1234/abc.def", "url_only"), ("ab cd ef", "too_short"), ("abcd efgh", None), ("a b c d e f g h i", "too_short"),
     ("1234 " * 10, None), ("123 456", "too_short"), ("see http://a.b", "too_short"), ("x" * 7 + " " + "1" * 32, "too_short"), ("x" * 7 + " " + "1" * 33, None)],
)
def test_texts_that_need_no_model(one, text, reason):
    assert one(state.bypass_reason(L(text).cast("string"))) == reason


def test_terminal_statuses_and_ids(one):
    over = ("done", " done_with_warnings ", "cancelled", "superseded", "error", "error: x", "compile_error in a", "errors")
    assert all(one(*(state.is_terminal(L(s)) for s in over)))
    assert not any(one(*(state.is_terminal(L(s)) for s in ("completed", "done!", "translating 1/2", "", "interrupted"))))
    assert one(*(state.is_job_id(L(s)) for s in (".a", "_b", "-c", "a..b", "pdf_x.1", "...", "x" * 128))) == (True,) * 7
    assert one(*(state.is_job_id(L(s).cast("string")) for s in ("..", "", "a/b", "a b", "é", "x" * 129, "a\n", None))) == (False,) * 8
    assert one(*(state.is_chunk_key(L(s)) for s in ("12", "input:a:b/c.tex:3", "input:/a:1", "input:a\\b:1", "x"))) == (True, True, False, False, False)


def span(text, y=10.0, size=10.0, font="Arial", flags=0):
    return F.struct(L(text).alias("text"), L(y).alias("y"), L(size).alias("size"), L(font).alias("font"), L(flags).alias("flags"))


def test_geometric_mathematics(one):
    of = lambda *spans: one(*(layout.is_geometric_math(span(*s), L(10.0), L(10.0)) for s in spans))
    assert of(("2", 7.0), ("2", 10.0, 8.0), ("12", 12.0), ("", 7.0)) == (False, False, False, False)  # footnote marks
    assert of(("x", 7.0), ("ij2k", 12.0), ("x", 10.0, 8.0), ("x", 8.5), ("hello", 7.0)) == (True, True, False, False, False)
    assert of(("α", 10.0, 8.4), ("a+b = long enough text", 7.0), ("n−1", 10.0, 8.0), ("½⅓", 10.0, 8.0), ("α", 10.0, 8.5)) == (True, True, True, True, False)


def test_mathematical_spans(one):
    assert one(layout.is_math_char(L("⅔")), layout.is_math_char(L("a"))) == (True, False)
    fonts = ("CMMI10", "rsfs10", "EUFM7", "stmary10", "wasy10", "lasy9", "esint10", "bbold12", "EUSM10", "EURM10", "XITSMath", "txsyb", "pxexa", "Neo Euler", "Boondox-r", "LMRoman10-Math", "Symbol")
    assert all(one(*(layout.is_math_span(span("a", font=f)) for f in fonts)))
    assert not any(one(*(layout.is_math_span(span("a", font=f)) for f in ("Arial", "CMR10", "Times-Italic"))))
    assert one(*(layout.is_math_span(span(t, flags=k)) for t, k in (("a", 1), (" αβa ", 0), ("α b", 0), ("", 0)))) == (True, True, False, False)


def test_styles(one):
    style = lambda font, flags=0: tuple(one(layout.span_style(span("a", font=font, flags=flags))))
    assert [style(f)[0] for f in ("Foo-Medi", "CMBX12", "Foo-Bd", "Foo-B", "Foobd", "DemiX", "Foo-Bx", "Arial")] == [True] * 6 + [False] * 2
    assert [style(f)[1] for f in ("CMTI10", "CMBXTI10", "Foo-It", "Foo-I", "Fooit", "Slanted", "Foo-Ix", "Arial")] == [True] * 6 + [False] * 2
    assert style("Arial", 16) == (True, False) and style("Arial", 2) == (False, True)
    block = F.array(span("   ab   ", font="X-Medi"), span("c", font="X"))
    assert one(layout.block_style(block)["bold"], layout.is_bold_block(block)) == (True, False)  # white space aside; and a planner's bold is by name
    assert one(layout.is_bold_block(F.array(span("abc", font="XBold"), span("de")))) is True
    assert tuple(one(layout.baseline(F.array(span("  ab ", 4.0, 8.0), span("c", 1.0, 11.0)), L(9.0)))) == (3.0, 9.0)
    assert tuple(one(layout.baseline(F.array(span("  ")), L(9.0)))) == (9.0, 10.0)


def test_narrow_boxes_and_columns(spark, one):
    assert one(*(layout.is_narrow_vertical(*map(L, b)) for b in ((0.0, 0.0, 20.0, 50.0), (0.0, 0.0, 24.9, 1.0), (0.0, 0.0, 30.0, 76.0), (0.0, 0.0, 30.0, 75.0), (0.0, 0.0, 40.0, 900.0)))) == (True, True, True, False, False)
    rows = [(1, 50.0, 280.0), (1, 60.0, 290.0), (1, 310.0, 550.0), (1, 320.0, 500.0), (2, 50.0, 550.0), (2, 70.0, 250.0), (3, 10.0, 100.0), (4, 300.0, 590.0), (5, 280.0, 500.0), (5, 40.0, 260.0), (1, 400.0, 420.0)]
    df = spark.createDataFrame([(p, 0.0, 9.0, a, z) for p, a, z in rows], "page_num int, y0 double, y1 double, x0 double, x1 double")
    got = {r.page_num: [tuple(c) for c in r["columns"]] for r in layout.columns(df, 600.0).collect()}
    # page 5 begins at 280, which is no side of the line 20 before the middle
    assert got == {1: [(50.0, 290.0), (310.0, 550.0)], 2: [(50.0, 550.0)], 3: [(0.0, 600.0)], 4: [(300.0, 590.0)], 5: [(40.0, 500.0)]}


def test_lowest_scores_first(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([80.0, 20.0, None, 40.0, 20.0, 95.0])], "id long, score double")
    ids = lambda t, n: sorted(r.id for r in state.low_quality(rows, t, n, "id").collect())
    assert ids(50.0, 2) == [1, 4] and ids(50.0, 9) == [1, 3, 4] and ids(10.0, 3) == [1, 3, 4] and ids(10.0, 9) == [0, 1, 2, 3, 4, 5]


def test_section_headers_by_size_and_weight(one):
    of = lambda t, size=10.0, bold=False: one(segments.is_header(L(t), L(size), L(bold)))
    long = "2.1 " + "A title of words that goes on and on for more than sixty chars"
    assert of("1 Intro") and not of(long) and of(long, 11.0) and of(long, 10.9, True) and not of(long, 10.9)
    assert of("Any heavy line", 11.5, True) and not of("Any heavy line", 11.4, True) and not of("Any heavy line", 20.0) and not of("x" * 80, 20.0, True) and not of("1 " + "A" * 99, 20.0, True)


def test_anchors(spark):
    pair = "array<struct<s string, t string>>"
    rows = [(7, [("a" * 800, "x"), ("b", "y")]), (8, []), (9, [(" ", " ")])]
    df = spark.createDataFrame(rows, f"idx int, l {pair}").select("idx", runs.handoff_anchor(F.col("l"), F.col("idx"), L("gemini"), L("grok")).alias("a"))
    got = {r.idx: r.a for r in df.collect()}
    assert got[7].asDict() == {"en": "[handoff 1] " + "a" * 688, "vi": "[handoff 1] x\n\n[handoff 2] y", "from_model": "gemini", "to_model": "grok", "chunk_index": 7, "reason": "cross_model_style_handoff"}
    assert got[8] is None and got[9] is not None  # the marks count as text
    schema = "i int, base struct<en string, vi string, style string>, handoff struct<en string, vi string, to_model string>"
    both = spark.createDataFrame([(1, ("a", "x", "s"), ("b", None, "m")), (2, ("a", "x", "s"), None), (3, None, ("b", "y", "m")), (4, None, None)], schema)
    m = {r.i: r.merged and r.merged.asDict(recursive=True) for r in runs.merged_anchors(both).collect()}
    assert m[1] == {"en": "a\n\nb", "vi": "x", "style": "s", "handoff": {"en": "b", "vi": None, "to_model": "m"}}
    assert m[2] == {"en": "a", "vi": "x", "style": "s", "handoff": None} and m[3] == {"en": "b", "vi": "y", "style": None, "handoff": None} and m[4] is None


def test_existing_runs_of_a_paper(spark):
    runs_ = [("pdf_b", "u", " The Title ", 3), ("pdf_a", None, "the title", 3), ("pdf_c", "v", "the title", 3), ("tex_a", "u", "the title", 3), ("pdf_d", "u", "the title", 4), ("pdf_e", "u", None, 3), ("pdf_z", "u", "THE TITLE", 3)]
    asked = [(1, "The title", 3, "u", False, None), (2, "The title", 3, "u", False, "pdf_b"), (3, "The title", 3, "x", True, None), (4, "The title", 3, "x", False, None), (5, " ", 3, "u", True, None), (6, "The title", 0, "u", True, None), (7, None, 3, "u", True, None)]
    got = runs.existing_pdf(spark.createDataFrame(asked, "upload int, title string, page_count int, owner string, is_admin boolean, exclude string"), spark.createDataFrame(runs_, "job_id string, owner string, title string, page_count int"))
    assert {r.upload: r.job_id for r in got.collect()} == {1: "pdf_b", 2: "pdf_z", 3: "pdf_a", 4: None, 5: None, 6: None, 7: None}


def test_log_numbers_go_on_for_a_run(spark, tmp_path):
    path = f"{tmp_path}/log"
    schema = "run_id string, job_id string, ts timestamp, phase string, event_type string, data struct<a string, b array<map<string,string>>, n int>"
    from datetime import datetime

    event = lambda run, second, kind: (run, "j", datetime(2026, 1, 1, 0, 0, second), "p", kind, ("x" * 4001, [{"k": "y" * 5000}], 3))
    sinks.log(spark.createDataFrame([event("r1", 2, "b"), event("r1", 1, "a"), event("r2", 5, "c")], schema), path)
    sinks.log(spark.createDataFrame([event("r1", 9, "d"), event("r1", 8, "e"), event("r3", 1, "f")], schema), path)
    rows = spark.read.json(path).collect()
    assert sorted((r.run_id, r.seq, r.event_type) for r in rows) == [("r1", 1, "a"), ("r1", 2, "b"), ("r1", 3, "e"), ("r1", 4, "d"), ("r2", 1, "c"), ("r3", 1, "f")]
    assert {r.data.a for r in rows} == {"x" * 4000 + "...[truncated 4001 chars]"} and {r.data.b[0].k for r in rows} == {"y" * 4000 + "...[truncated 5000 chars]"}


def test_links_are_masked_and_put_back(one):
    text = "see http://a.b/c and me@x.org, doi: 10.1/z <<URL_9>> end www.x.y"
    m = one(masking.masked_links(L(text)))
    assert m.masked == "see <<URL_1>> and <<URL_2>>, <<URL_3>> <<URL_9>> end <<URL_4>>" and list(m["values"]) == ["http://a.b/c", "me@x.org", "doi: 10.1/z", "www.x.y"]
    assert one(masking.restored_links(L(m.masked + " <<URL_2>>"), F.array(*map(L, m["values"])))) == text + " me@x.org"
    assert tuple(one(masking.masked_links(L(None).cast("string")))) == ("", [])


def test_prompts_of_terms(spark):
    rows = [(1, 0, "b", "B", True, 1), (1, 0, "a", "A", True, 2), (1, 0, "c", "C", False, 3), (1, 1, "d", "D", False, 1)]
    df = spark.createDataFrame(rows, "conv_id long, idx long, en string, vi string, locked boolean, ordinal long")
    got = {r.idx: (r.n_terms, r.prompt) for r in glossary.prompts(df).collect()}
    assert got[0] == (3, f'{glossary.LOCKED_HEAD}\n  "a" → "A"\n  "b" → "B"\n\n{glossary.TERMS_HEAD}\n  "c" → "C"\n\n') and got[1] == (1, f'{glossary.TERMS_HEAD}\n  "d" → "D"\n\n')


@pytest.mark.parametrize("shard", [1 << 24, 8])
def test_terms_are_found_by_automata(spark, monkeypatch, shard):
    monkeypatch.setattr(glossary, "IN_PLACE", 2)
    monkeypatch.setattr(glossary, "SHARD_BYTES", shard)
    terms = spark.createDataFrame([("a", 1), ("ab", 2), ("ab", 3), ("bc d", 4), ("", 5), (None, 6), ("é", 7), ("zz", 8)], "en string, n int")
    texts = spark.createDataFrame([(1, "ABC d"), (2, ""), (3, None), (4, "É zzz")], "id int, src string").withColumn("__t", F.lit("own"))
    got = glossary.matches(texts, terms)
    assert got.columns == ["id", "src", "__t", "en", "n"]
    assert sorted((r.id, r.n) for r in got.collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 5), (4, 5), (4, 7), (4, 8)]
    assert glossary.matches(texts, terms.limit(0)).collect() == []


def test_statuses_for_clients(spark):
    docs = [("a", '{"status": "translating 3/8", "failed_chunks": [1, 2], "glossary": {"terms": {"x": "y"}, "seed_terms": {}, "document_terms": null}, "title": "", "phase": "p"}'), ("b", "{}"), ("c", '{"status": "done_with_warnings", "mode": "fast", "failed_chunks": []}'), ("d", '{"status": "translating 1/0"}')]
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "job_id string")
    got = {r.job_id: r for r in progress.status_rows(asked, progress.read(spark.createDataFrame(docs, "job_id string, json string"))).collect()}
    assert (got["a"].status, got["a"].current_chunk, got["a"].total_chunks, got["a"].progress_percent, got["a"].failed_chunks) == ("translating 3/8", 3, 8, 38, 2)
    assert (got["a"].glossary_count, got["a"].glossary_seed_count, got["a"].glossary_document_count, got["a"].title, got["a"].phase) == (1, 0, None, None, "p")
    assert (got["b"].status, got["b"].mode, got["b"].agentic, got["b"].progress_percent) == ("pending", "standard", False, None)
    assert (got["c"].progress_percent, got["c"].mode, got["c"].failed_chunks) == (100, "fast", None) and got["d"].progress_percent == 0
    assert (got["e"].status, got["e"].source_type, got["e"].mode) == ("unknown", "pdf_only", None)


def test_pairs_to_judge_come_from_the_maps_where_files_have_none(spark, tmp_path):
    (tmp_path / "j/chunks").mkdir(parents=True)
    doc = spark.createDataFrame([('{"input_chunks": {"2": " a source of twenty characters ", "x": "another source of twenty chars", "3": "short"}, "translated_chunks": {"2": "t", "x": "u", "3": "v"}}',)], "json string")
    got = files.judge_pairs(spark, f"{tmp_path}/j", doc).collect()
    assert sorted((str(r.idx), r.src, r.mt) for r in got) == [("2", "a source of twenty characters", "t"), ("None", "another source of twenty chars", "u")]
    (tmp_path / "j/chunks/chunk_001_original.txt").write_text("the file has a source of its own")
    (tmp_path / "j/chunks/chunk_001_translated.txt").write_text("dịch")
    assert [(r.idx, r.mt) for r in files.judge_pairs(spark, f"{tmp_path}/j", doc).collect()] == [(1, "dịch")]


def test_conversion_of_deep_markup():
    for tag in ("i", "span", "div", "blockquote", "li"):
        title, body = convert.html_body("<body>" + f"<{tag}>" * 5000 + "deep" + f"</{tag}>" * 5000)
        assert "deep" in body and title == ""
    assert convert.html_body("<body><blockquote><p>a</p><blockquote>b</blockquote></blockquote><div>c<b>d</b></div>")[1] == "\\begin{quote}\na\n\n\\begin{quote}\nb\n\n\\end{quote}\n\n\\end{quote}\n\nc\n\n\\textbf{d}\n"


@pytest.mark.parametrize(
    "original, title, job, name",
    [("A paper.v2.pdf", "T", "pdf_x", "A paper.v2"), (None, "On a/b: c?", "pdf_x", "On a_b_ c_"), ("", "", "pdf_x_1", "x_1"), (None, None, "tex_a", "tex_a"), (".pdf", "T", "pdf_x", ".pdf"), ("  .pdf", None, "pdf_x", "document"), ("noend", "T", "x", "noend"), ("a\tb\n<>.docx", None, "x", "a_b_")],
)
def test_names_for_downloads(one, original, title, job, name):
    assert one(T.friendly_name(L(original).cast("string"), L(title).cast("string"), L(job))) == name


def test_f_scores_weigh_recall(one):
    of = lambda beta: round(one(scoring._f(L(3.0), L(4.0), L(6.0), beta)), 9)
    assert (of(1.0), of(2.0), of(0.5)) == (0.6, round(5 * 0.75 * 0.5 / (4 * 0.75 + 0.5), 9), round(1.25 * 0.75 * 0.5 / (0.25 * 0.75 + 0.5), 9))


def test_advice_on_models(spark):
    doc = lambda **k: __import__("json").dumps(k)
    tries = {"0": [{"selected_model": "Gemini", "ok": True}, {"model": "grok", "ok": False}, {"selected_model": "", "model": "grok"}, {"selected_model": "other", "ok": False}, 5], "1": "no list", "2": [{"model": "grok", "ok": None}]}
    rows = [("a", 3, doc(models=["GROK"], translation_attempts=tries, failed_chunks_gemini=[1, 2], status="done")), ("b", 2, doc(status="error: gemini down", error_detail={"message": "Gemini and GROK"})), ("c", 1, doc(models=[], translation_attempts=[])), ("old", 0, doc(failed_chunks_grok=[1]))]
    docs = spark.createDataFrame(rows, "job_id string, changed int, json string")
    v = progress.read(docs).join(docs.select("job_id", "changed"), "job_id")
    (r,) = advice.preference_advice(v, "grok", 3).collect()
    assert (r.models, r.primary, r.execution_order[:2], r.fallback_models[0], r.recent_jobs, r.selected_jobs) == (["grok"], "grok", ["grok", "gemini"], "gemini", 3, 1)
    assert r.usage == {"gemini": 1, "grok": 3} and r.failures == {"gemini": 3, "grok": 2} and r.primary_usage_share == 0.75
    assert r.warnings == ["emergency_fallback_enabled", "primary_recent_failures"]
    (r,) = advice.preference_advice(v.limit(0), "copilot, gemini").collect()
    assert (r.usage, r.failures, r.primary_usage_share, r.warnings, r.recent_jobs) == ({}, {}, None, [], 0)
