"""Literal cases, and brute force for what SQL can't express."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum import catalog
from vellum.operators import convert, diagnostics, events, glossary, latex, layout, masking, quality, relational, scoring, segments
from vellum.plans import responses
from vellum.sources import files
from vellum.streaming import state

SF = "/root/testdata/sf0.001"
LONG = "This is a long English sentence with many words that nobody has translated so far today"
VIET = "Đây là một câu tiếng Việt dài với nhiều từ mà ai đó đã dịch cho đến hôm nay rồi đó"


def pairs(spark, rows):
    return spark.createDataFrame([(c, i, s, m) for c, i, s, m in rows], "conv_id long, idx long, src string, mt string")


def test_quality_literals(spark):
    rows = [(1, i, LONG, VIET) for i in range(2)] + [(2, i, LONG, "") for i in range(5)] + [(3, 0, "Fig. 1", "")] + [(4, 0, "The value is 42.3 in this long experiment here", "Giá trị là lớn trong thí nghiệm dài này ở đây")]
    rows += [(5, 0, "Chapter 2 of the book was good", "Chương của cuốn sách là tốt"), (6, 0, LONG, VIET * 5), (7, 0, " ", "x")]
    got = {r.conv_id: r for r in quality.quality_scores(pairs(spark, rows)).collect()}
    assert got[1].score == 100 and got[1].untranslated_blocks == 0
    assert got[2].score == pytest.approx(70) and got[2].untranslated_blocks == 5 and got[2].errors == 5
    assert got[3].infos == 1 and got[4].warnings == 1 and got[5].warnings == 0 and got[6].warnings == 1
    assert got[7].score == 100 and got[7].total_blocks == 1


def test_glossary_issues_cost_half_a_point(spark):
    rows = pairs(spark, [(1, i, "A neural network learns from examples of many kinds", VIET) for i in range(5)])
    terms = spark.createDataFrame([("neural network", "mạng nơ-ron", 1, False)], "en string, vi string, ordinal long, locked boolean")
    found = glossary.matches(rows, terms)
    assert [r.violations for r in glossary.compliance(found).collect()] == [5]
    assert glossary.compliance(found.limit(2)).count() == 0
    n = spark.createDataFrame([(1, 1)], "conv_id long, n long")
    assert quality.quality_scores(rows, n).first().score == 99.5


def test_glossary_cap_and_large_glossaries(spark, monkeypatch):
    words = [f"term{i:02d}" for i in range(60)]
    terms = spark.createDataFrame([(w, w[::-1], i, i == 59) for i, w in enumerate(words)], "en string, vi string, ordinal long, locked boolean")
    rows = pairs(spark, [(1, 0, " ".join(words).upper(), "x"), (2, 0, "term00 ab", "x")])
    small = glossary.matches(rows, terms)
    assert small.where("conv_id = 1").count() == 60 and glossary.capped(small).where("conv_id = 1").count() == 40
    monkeypatch.setattr(glossary, "IN_PLACE", 10)
    assert sorted(map(tuple, glossary.matches(rows, terms).select("conv_id", "en").collect())) == sorted(map(tuple, small.select("conv_id", "en").collect()))
    assert glossary.matches(rows, terms.limit(0)).count() == 0


def test_large_glossaries_keep_all_short_terms(spark, monkeypatch):
    short = [a + b for a in "abcdef" for b in ["", *"abcdef"]]
    terms = spark.createDataFrame([(t, t[::-1], i, False) for i, t in enumerate([*short, "abc"])], "en string, vi string, ordinal long, locked boolean")
    texts = ["abcdef fedcba", "AA bb", "x", "", "c"]
    rows = spark.createDataFrame([(i, 0, t, "") for i, t in enumerate(texts)], "conv_id long, idx long, src string, mt string")
    monkeypatch.setattr(glossary, "IN_PLACE", 10)
    got = sorted(tuple(r) for r in glossary.matches(rows, terms).select("conv_id", "en").collect())
    assert got == sorted((i, t) for i, x in enumerate(texts) for t in [*short, "abc"] if t in x.lower())


def test_glossary_merge(spark):
    known = spark.createDataFrame([("a", "x", None, 1, 0.5), ("b", "y", None, 3, 0.9), ("c", "z", "law", 2, 0.5), ("e", "e", "", 9, 0.95)], "en string, vi string, field string, frequency long, confidence double")
    job = spark.createDataFrame([("A ", "X", " ML "), ("b", "other", "ML"), ("c", "other", "ML"), ("d", "new ", "x" * 70), ("e", " E", "bio"), ("f", "  ", "ML"), (" ", "v", "ML")], "en string, vi string, field string")
    got = {r.en: (r.vi, r.field, r.frequency, r.confidence) for r in glossary.merged(known, job).collect()}
    assert got == {"a": ("x", "ML", 2, 0.6), "b": ("y", None, 3, 0.9), "c": ("z", "law", 3, 0.5), "d": ("new", "x" * 64, 1, 0.5), "e": ("e", "bio", 10, 0.95)}


def test_diagnostics_literals(spark):
    src = "x" * 199 + "."
    got = lambda rows: {r.cause: r for r in diagnostics.findings(pairs(spark, rows)).collect()}
    cut = got([(1, 0, src, "y" * 30)])
    assert cut["TRUNCATED_RESPONSE"].confidence == 0.63 and cut["TRUNCATED_RESPONSE"].affected == [0] and cut["TRUNCATED_RESPONSE"].severity == "warning"
    assert got([(1, 0, "X" * 199 + ".", "y" * 199 + ".")]) == {}
    assert "HALLUCINATION" not in got([(1, 0, "short source.", "y" * 500)])
    falling = [(1, i, "S" * 99 + ".", "t" * (100 + 12 * i)) for i in range(9)]
    assert got(falling)["SESSION_LIMIT"].severity == "warning"
    assert got([(1, i, "S" * 99 + ".", "t" * 100) for i in range(9)]) == {}


def test_error_weights_and_chrf(spark):
    w = spark.range(1).select(scoring.error_weight(F.lit("accuracy"), F.lit("major")), scoring.error_weight(F.lit("odd"), F.lit("critical")), scoring.error_weight(F.lit("style"), F.lit("odd"))).first()
    assert tuple(w) == (5.0, 25.0, 1.0)
    got = {r.conv_id: r for r in scoring.chrf(pairs(spark, [(1, 0, "same text here", "same text here"), (2, 0, "abc", "xyz"), (3, 0, "ab", "ab"), (4, 0, "", "x")])).collect()}
    assert got[1].chrf == 100 and got[1].agreement == 100 and got[2].chrf == 0
    assert got[3].chrf == pytest.approx(3 / 8 * 100) and got[3].agreement == 100 and got[4].chrf == 0


def test_accounts_fold(spark):
    rows = [(i, u, float((i * 37 + u * 11) % 100)) for i in range(200) for u in (1, 2)]
    log = spark.createDataFrame(rows, "seq long, user_id long, value double").withColumn("us", F.col("seq"))
    got = {r.user_id: r for r in events.accounts(log).collect()}
    for u in (1, 2):
        ok = fail = cool = 0
        avg, ring = 0.0, []
        for _, v in sorted((i, v) for i, x, v in rows if x == u):
            if v < 10:
                cool += 1
            else:
                ok, fail, avg = ok + (v >= 30), fail + (v < 30), v if avg == 0 else 0.7 * avg + 0.3 * v
            ring = [*ring, v >= 30][-20:]
        assert (got[u].success, got[u].fail, got[u].cooldowns) == (ok, fail, cool)
        assert got[u].avg_latency == pytest.approx(avg, abs=1e-6) and got[u].recent == pytest.approx(sum(ring) / 20)
    few = events.accounts(spark.createDataFrame([(1, 1, 40.0, 5), (2, 1, 20.0, 6), (3, 2, 5.0, 7), (4, 1, 9.0, 8)], "seq long, user_id long, value double, us long")).collect()
    told = {r.user_id: (r.success, r.fail, r.cooldowns, r.avg_latency, r.last_latency, r.last_used, r.last_cooldown) for r in few}
    assert told == {1: (1, 1, 1, pytest.approx(34.0), 20.0, 6, 8), 2: (0, 0, 1, 0.0, 0.0, None, 7)}


def test_adaptive_schedule(spark):
    """Signals and scores worked out by hand from the weights 0.45, 0.15, 0.20 and 0.20."""
    schema = "user_id long, success long, fail long, cooldowns long, avg_latency double, last_latency double, recent double, last_used long, last_cooldown long"
    s = 1_000_000
    rows = [(1, 8, 2, 1, 10.0, 12.0, 0.8, 700 * s, 100 * s), (2, 0, 0, 0, 0.0, 0.0, None, None, None), (3, 1, 1, 2, 40.0, 40.0, 0.5, 970 * s, 990 * s), (4, 0, 0, 3, 0.0, 0.0, 0.0, None, 5 * s)]
    state = spark.createDataFrame(rows, schema)
    got = {r.user_id: (r.s_success, r.s_latency, r.s_cooldown, r.s_idle) for r in events.components(state, F.lit(1000 * s)).collect()}
    assert got[1] == (0.8, pytest.approx(0.606531, abs=1e-6), pytest.approx(0.8), 0.5)
    assert got[2] == (0.85, 0.85, 0.85, 0.85)
    assert got[3] == (0.5, pytest.approx(0.135335, abs=1e-6), 0.0, pytest.approx(0.05)) and got[4] == (0.0, 0.85, 1.0, 1.0)
    pick = events.schedule(state, spark.createDataFrame([(1000 * s,)], "now long")).first()
    assert (pick.adaptive, pick.best_score, pick.lru, pick.cooldown_aware, pick.round_robin) == (2, 0.85, 2, 2, 1)
    pick = events.schedule(state.where("user_id <> 2"), spark.createDataFrame([(1000 * s,)], "now long")).first()
    assert (pick.adaptive, pick.best_score) == (1, pytest.approx(0.45 * 0.8 + 0.15 * 0.606531 + 0.2 * 0.8 + 0.2 * 0.5, abs=1e-6))


def test_keyed_tables(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, x string, y int")
    new = spark.createDataFrame([(2, None, "drop"), (3, "c", "drop")], "id long, x string, z string")
    assert sorted(map(tuple, relational.upsert(t, new, ["id"]).collect())) == [(1, "a", 1), (2, None, 2), (3, "c", None)]
    assert [r.id for r in relational.delete(t, new, ["id"]).collect()] == [1]
    assert sorted(r.id for r in relational.insert_new(t, new.drop("z"), ["id"]).collect()) == [1, 2, 3]
    v = spark.createDataFrame([(1, float(i), 1) for i in range(1, 101)], "num_tabs long, duration double, pdf long")
    assert tuple(relational.latencies(v).first()) == (1, 100, 50.5, 95.0)


def test_packing_of_blocks(spark):
    assert segments.greedy([3, 3, 3, 10, 1], 6) == [0, 0, 1, 2, 3]
    assert segments.greedy([], 6) == []
    assert segments.bounded([10, 10, 10], [False, True, False], [False] * 3, soft=15, hard=100) == [0, 0, 1]
    assert segments.bounded([10, 10], [False, False], [False] * 2, soft=15, hard=18) == [0, 1]
    docs = spark.createDataFrame([(1, "aaa\nbbb\nccc"), (2, None)], "doc_id long, text string")
    assert [r.chunk for r in segments.chunked(docs, 6).where("doc_id = 1").orderBy("block_idx").collect()] == [0, 0, 1]


def test_masking_literals():
    for text, n in [("The energy is given by $E = mc^2$ in special relativity.", 1), ("The book costs $5. End.", 0), (r"We use \frac{a}{b} and \alpha here.", 2), ("", 0)]:
        kept = []
        masked = masking.mask(text, kept)
        assert len(kept) == n and masking.unmask(masked, kept) == text
    shared = []
    assert masking.mask("$a + b$", shared) + masking.mask("$c + d$", shared) == "<<MATH_1>><<MATH_2>>"


def test_conversions(spark):
    assert convert.markdown_body("# A & B\n- x\n- *y*\n\n```\n# no\n```") == "\\section*{A \\& B}\n\n\\begin{itemize}\n  \\item x\n  \\item \\textit{y}\n\\end{itemize}\n\n\\begin{verbatim}\n# no\n\\end{verbatim}\n"
    md = "one\n two `a_b*c*` and **bold**\n1. x\n2) y\n- z\ntext [t](u) __b__\n***\n###### deep #\n```py\nopen"
    want = "one two \\texttt{a\\_b*c*} and \\textbf{bold}\n\n\\begin{enumerate}\n  \\item x\n  \\item y\n\\end{enumerate}\n\\begin{itemize}\n  \\item z\n\\end{itemize}\n\ntext \\href{u}{t} \\\\textit{\\}b\\\\textit{\\}\n\n"
    assert convert.markdown_body(md) == want + "\\noindent\\rule{\\linewidth}{0.4pt}\n\n\\subparagraph*{deep}\n\n\\begin{verbatim}\nopen\n\\end{verbatim}\n"
    assert convert.html_body("<title>T</title><nav>n</nav><body><h1>H</h1><p>a &amp; b</p>") == ("T", "\\section*{H}\n\na \\& b\n")
    page = "<body><h2>A <i>b</i></h2><p>x <b>y</b>! <a href='u'>l</a> <a href='#k'>m</a><br>z</p><ul><li>1</li><li>2 <code>c_d</code></li></ul><ol><li>o</li></ol><hr><table><tr><td>x</td><th>z</th></tr></table><blockquote><p>q</p></blockquote><pre>  a_b\n c </pre><div>d<section>e</section></div><script>s</script><aside>n</aside><span>f</span></body>"
    want = ["\\subsection*{A \\textit{b}}", "", "x \\textbf{y}! \\href{u}{l} m \\\\ z", "", "\\begin{itemize}", "  \\item 1", "  \\item 2 \\texttt{c\\_d}", "\\end{itemize}", "", "\\begin{enumerate}", "  \\item o", "\\end{enumerate}", ""]
    want += ["\\noindent\\rule{\\linewidth}{0.4pt}", "", "x \\quad | \\quad z", "", "\\begin{quote}", "q", "", "\\end{quote}", "", "\\begin{verbatim}", "  a_b\n c", "\\end{verbatim}", "", "d", "", "e", "", "f", ""]
    assert convert.html_body(page) == ("", "\n".join(want))
    assert spark.range(1).select(convert.text_body(F.lit("a_b\r\n c\n\n \n\nc\\\n"))).first()[0] == "a\\_b \\\\ c\n\nc\\textbackslash\\{\\}\n"
    up = spark.createDataFrame([("a.TXT", b"x_y", ""), ("b.md", b"# h", "T&x"), ("c.htm", b"<title>W</title><body><p>p", None), ("d.doc", b"x", "")], "name string, content binary, title string")
    tex = [r.tex for r in convert.converted(up).orderBy("name").collect()]
    assert tex[3] is None and "\\title{Document}" in tex[0] and tex[0].endswith("\\maketitle\n\nx\\_y\n\n\\end{document}\n") and "\\title{T\\&x}" in tex[1] and "\\title{W}" in tex[2]
    assert spark.range(1).select(convert.decoded(F.unhex(F.lit("e9"))), convert.decoded(F.unhex(F.lit("c3a9")))).first()[:] == ("é", "é")


def test_responses(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    rows = spark.createDataFrame([(1, '```json\n[{"index":2,"errors":[]}]\n```', [2, 5]), (2, '[{"index":0,"score":82}]', [0]), (3, "not json at all", [0, 1])], "id long, raw string, asked array<int>")
    got = {(r["id"], r["index"]): r["score"] for r in responses.judge_scores(rows, scoring.error_weight).collect()}
    assert got == {(1, 2): 100.0, (1, 5): None, (2, 0): 82.0, (3, 0): None, (3, 1): None}
    assert one(responses.strip_artefacts(F.lit("a\nNote: this\nb\n"))) == "a\nb" and one(responses.fenced(F.lit("```tex\ny\n```"))) == "y"
    assert [tuple(r) for r in one(responses.term_lines(F.lit("Deep Net → mạng sâu → ML\nno\nX → y")))] == [("deep net", "mạng sâu", "ML"), ("x", "y", None)]
    assert [r.en for r in one(responses.strict_term_lines(F.lit("# c → d\nabc → d\nab cd → e")))] == ["ab cd"]
    assert [tuple(r) for r in one(responses.numbered(F.lit("[1] one\nmore\n\n[3] two")))] == [(1, "one\nmore"), (3, "two")]
    assert one(responses.model_preference(F.lit("grok; zzz, gemini grok"))) == ["grok", "gemini"]
    assert one(responses.execution_order(F.array(F.lit("grok"))))[0] == "grok" and one(responses.judge_backend(F.lit("gemini"), F.lit("gemini"))) == "chatgpt"
    assert one(responses.normalised_score(F.lit("0.5"))) == 50 and one(responses.normalised_score(F.lit("x"))) is None and one(responses.clamped_tabs(F.lit("9"))) == 6


def test_layout(spark):
    span = "struct<text string, font string, size double, flags int, y double>"
    rows = [(1, 0, "Fig. 2: x", 0.0, 0.0, 100.0, 20.0, [("ab", "Arial-Bold", 10.0, 0, 5.0), ("c", "Arial", 8.0, 2, 6.5)]), (1, 1, "b", 0.0, 30.0, 300.0, 50.0, [("αβ", "CMMI10", 10.2, 0, 1.0)])]
    b = spark.createDataFrame(rows, f"page_num int, block_idx int, text string, x0 double, y0 double, x1 double, y1 double, spans array<{span}>")
    s = b.orderBy("block_idx").select(layout.caption_kind(F.col("text")), layout.block_style(F.col("spans"))["bold"], layout.is_bold_block(F.col("spans")), layout.is_math_span(F.col("spans")[0]), layout.baseline(F.col("spans"))["y"]).collect()
    assert tuple(s[0]) == ("figure", True, True, False, 5.5) and s[1][3] and s[1][0] is None
    rects = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 10.0)], "page_num int, x0 double, y0 double, x1 double, y1 double")
    assert {r.block_idx: r.inside for r in layout.in_rects(b, rects).collect()} == {0: True, 1: False}
    assert [r.gap for r in layout.gaps(b).orderBy("block_idx").collect()] == [10.0, None]
    assert layout.bands(b, 400).count() == 2 and layout.body_size(b.withColumn("size", F.lit(9.8)).withColumn("translatable", F.lit(True))).first()[0] == 10.0 and layout.body_size(b.withColumn("size", F.lit(9.8)).withColumn("translatable", F.lit(False))).first()[0] == 10.0


def test_files(spark, tmp_path):
    (tmp_path / "job/chunks").mkdir(parents=True)
    (tmp_path / "job/chunks/chunk_001_original.txt").write_text("source text of some length")
    (tmp_path / "job/chunks/chunk_001_translated.txt").write_text("bản dịch")
    (tmp_path / "job/chunks/chunk_002_original.txt").write_text("alone")
    assert sorted(map(tuple, files.chunk_files(spark, f"{tmp_path}/job").collect())) == [(1, "source text of some length", "bản dịch"), (2, "alone", "")]
    assert files.judge_pairs(spark, f"{tmp_path}/job").count() == 1
    (tmp_path / "log.jsonl").write_text(json.dumps({"event_type": "a.b", "seq": 1}) + "\n\nbroken\n")
    log, n = files.event_log(spark, f"{tmp_path}/log.jsonl")
    assert log.count() == 1 and n == 3
    (tmp_path / "packs").mkdir()
    (tmp_path / "packs/ml.json").write_text(json.dumps({"name": "M", "terms": {"a": "b"}}))
    (tmp_path / "packs/bad.json").write_text(json.dumps({"name": "no terms"}))
    assert [(r.id, r.term_count) for r in files.packs(spark, f"{tmp_path}/packs").collect()] == [("ml", 1)]
    (tmp_path / "arc").mkdir()
    with zipfile.ZipFile(tmp_path / "arc/a.zip", "w") as z:
        z.writestr("main.tex", "\\begin{document}\\input{part}\\input{../x}")
        z.writestr("a.tex", "x")
        z.writestr("part.tex", "y")
        z.writestr("../evil.tex", "z")
    with tarfile.open(tmp_path / "arc/b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("only.tex")
        info.size = 1
        t.addfile(info, io.BytesIO(b"q"))
    members = files.archive_members(spark, f"{tmp_path}/arc/*")
    assert sorted(r.member for r in members.collect()) == ["a.tex", "main.tex", "only.tex", "part.tex"]
    assert sorted(r.main for r in files.main_tex(members).collect()) == ["main.tex", "only.tex"]
    assert [(r.member, r.target) for r in files.inputs(members).collect()] == [("main.tex", "part.tex")]


def test_streams(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    base.repartition(3).write.parquet(f"{tmp_path}/in")

    def drain(stream, mode, name):
        q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(240)
        return spark.table(name)

    done = drain(state.counts(state.source(spark, f"{tmp_path}/in", 9), late="100 days"), "complete", "counts")
    assert done.agg(F.sum("n")).first()[0] == base.count()
    last = drain(state.accounts(state.source(spark, f"{tmp_path}/in", 9)), "update", "accounts").groupBy("user_id").agg(F.max("success").alias("s"))
    assert last.agg(F.sum("s")).first()[0] == base.where("value >= 30").count()
    q = state.publish(state.source(spark, f"{tmp_path}/in", 9), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(240)
    assert spark.read.parquet(f"{tmp_path}/out").count() == base.count()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_every_query_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


def test_keyed_decisions(spark):
    from vellum.operators import state as decisions

    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(decisions.bypass_reason(F.lit(t))) for t in ("", "http://a.b", "7", "words here")] == ["empty", "url_only", "too_short", None]
    assert one(decisions.output_issues(F.lit(10), F.lit(10), F.lit(100.0), F.lit(25.0))) == ["strict", "proofread"]
    assert one(decisions.is_chunk_key(F.lit("input:a/b.tex:12"))) and not one(decisions.is_chunk_key(F.lit("input:../b:1"))) and not one(decisions.is_job_id(F.lit("..")))
    assert one(decisions.upload_kind(F.lit("X.TAR.GZ"))) == "latex"
    s = decisions.sections_of_chunks(spark.createDataFrame([(1, 0), (1, 2)], "doc_id long, chunk long"), spark.createDataFrame([(1, 0, 0), (1, 1, 150), (1, 2, 201)], "doc_id long, section long, first long"))
    assert sorted((r.chunk, r.section) for r in s.collect()) == [(0, 0), (2, 1)]
    e = spark.createDataFrame([(1, "\\begin{a}\\begin{b}"), (1, "\\end{a}"), (1, "% \\end{b}")], "doc_id long, text string")
    assert [tuple(r) for r in decisions.environment_counts(e).collect()] == [(1, "b", 1, 0)]
    a = spark.createDataFrame([(1, "m", "own"), (None, "m", "general")], "chunk long, model string, anchor string")
    asked = spark.createDataFrame([(1, "m"), (2, "m"), (3, "z")], "chunk long, model string")
    assert sorted((r.chunk, r.anchor) for r in decisions.handoff(asked, a).collect()) == [(1, "own"), (2, "general"), (3, None)]


def test_latex_text(spark):
    from vellum.operators import latex

    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(latex.without_comments(F.lit("a % b\n % c\n\nd"))) == "a % b\n\nd"
    assert one(latex.preamble(F.lit("p\\begin{document}b")))["body"] == "\\begin{document}b"
    assert one(latex.summary(F.lit("One. Two! Three."))) == "One. Two" and one(latex.summary(F.lit("word " * 60))).endswith("word...")
    assert latex.split_blocks("a\n\nb \\begin{x}1\\begin{x}2\\end{x}\\end{x}\\section{S}\nrest\n\nend") == ["a", "b ", "\\begin{x}1\\begin{x}2\\end{x}\\end{x}", "\\section{S}\n", "rest", "end"]
    assert latex.unbalanced("\\begin{a}\n\\end{b}\n% \\end{a}") == [(2, "closes b"), (1, "open a")]
    assert one(latex.split_toc(F.lit("Contents here 1.1 Intro words 1.2 More words"))) == "Contents here\n1.1 Intro words\n1.2 More words"
    assert one(latex.bound_compounds(F.lit("Học máy và học sâu"), ["học máy", "học sâu"])) == "Học\u00a0máy và học\u00a0sâu"
    rows = spark.createDataFrame([(1, "\\begin{a}x\\end{a}", "\\begin{a}x")], "id long, src string, mt string")
    assert [tuple(r) for r in latex.lost_environments(rows).collect()] == [(1, "\\end{a}", 1)]
    known = spark.createDataFrame([("A  b", "first", 1), ("a b", "last", 2)], "src string, mt string, ordinal long")
    assert latex.cell_translations(spark.createDataFrame([("a B",)], "cell string"), known).first().mt == "last"


def test_codecs_and_rounds(spark):
    from vellum.plans import codecs

    rows = spark.createDataFrame([(1, "<b>src</b>", None), (2, "x", "old")], "id long, text string, translated_text string")
    fixes = spark.createDataFrame([(1, "bản mới"), (2, "no accents")], "id long, fix string")
    got = {r.id: (r.src, r.mt) for r in codecs.CODECS["pdf"].apply(rows, fixes, ["id"]).collect()}
    assert got == {1: ("<b>src</b>", "bản mới"), 2: ("x", "old")}
    assert codecs.CODECS["docx"].pairs(rows).where("id = 1").first().src == "src"
    state = spark.createDataFrame([(1, 0.5, 30, 5), (2, 0.9, 20, None), (3, 0.9, 10, 1)], "user_id long, score double, last_used long, last_cooldown long")
    assert [codecs.pick(state, s).first().user_id for s in ("adaptive", "lru", "cooldown_aware")] == [2, 3, 2]
    assert codecs.pick(state, "round_robin", 4).first().user_id == 2
    with pytest.raises(ValueError):
        codecs.pick(state, "nope")
    src = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, src string")
    made = lambda d, k: d.withColumn("mt", F.concat(F.lit(f"v{k} "), "src"))
    scored = lambda d: d.withColumn("score", F.when((F.col("id") == 1) & F.col("mt").startswith("v1"), 40.0).when(F.col("id") == 2, 50.0).otherwise(80.0))
    out = {r.id: (r.mt, r.attempts, r.passed) for r in codecs.rounds(src, made, scored).collect()}
    assert out == {0: ("v1 a", 1, True), 1: ("v2 b", 2, True), 2: ("v1 c", 3, False)}


def test_layout_rules_by_hand(spark):
    edge = spark.createDataFrame([(50.0, 70.0), (60.0, 939.0), (60.0, 941.0), (59.9, 500.0), (950.0, 960.0)], "y0 double, y1 double")
    assert [r[0] for r in edge.select(layout.is_header_footer(F.col("y0"), F.col("y1"), F.lit(1000.0))).collect()] == [True, False, True, True, True]
    texts = ["Figure 1: x", "fig. 2. y", "Fig 3 — z", "Table 3 - t", "Hình 4: h", "BẢNG 5. b", "Biểu đồ 6: d", "  bảng 7:", "Table 8 without", "Tab. 9: x", "see Figure 1: x", "Figure IV: x", ""]
    kinds = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(layout.caption_kind(F.col("t"))).collect()]
    assert kinds == ["figure", "figure", "figure", "table", "figure", "table", "figure", "table", None, None, None, None, None]
    # 103 wide at size 10: 20.6 columns; 40 high: 2.963 lines; the product 61.04 is cut, its factors are not
    one = lambda *x: spark.range(1).select(layout.capacity(*map(F.lit, x))).first()[0]
    assert one(0.0, 0.0, 103.0, 40.0, 10.0) == 61 and one(5.0, 0.0, 5.0, 40.0, 10.0) == 0 and one(9.0, 0.0, 5.0, 40.0, 10.0) == 0
    assert one(0.0, 0.0, 54.0, 54.0, 1.0) == one(0.0, 0.0, 54.0, 54.0, 4.0) == 270
    sizes = spark.createDataFrame([(0, i, s, t) for i, (s, t) in enumerate([(9.76, True), (10.2, True), (12.0, False), (12.0, False), (12.0, False), (8.0, True)])], "page_num int, block_idx int, size double, translatable boolean")
    assert layout.body_size(sizes).first()[0] == 10.0


def test_block_budgets_by_hand(spark):
    rows = [("plain", 100, 50), ("plain", 100, 200), ("plain", 0, 50), ("plain", 0, 0), ("table", 100, 50), ("table", 10, 50), ("table", 0, 50), ("caption", 100, 50), ("caption", 10, 50), ("caption", 0, 50)]
    b = spark.createDataFrame(rows, "kind string, fits int, n int").select(layout.block_budget(F.col("fits"), F.col("n"), F.col("kind")))
    assert [r[0] for r in b.collect()] == [114, 220, 70, 100, 105, 50, 57, 108, 52, 60]
    text = layout.budgeted_text(spark.createDataFrame([(1, 9, "cell", "table", 20), (1, 3, "plain text", "plain", 44), (1, 12, "Hình 1: x", "caption", 10)], "chunk long, block_idx long, text string, kind string, budget int"))
    assert text.first().text == "[1] (max ~44 chars) plain text\n\n[2] (table cell, max ~20 chars) cell\n\n[3] (caption, max ~10 chars) Hình 1: x"


def test_prompt_budgets_are_read_back(spark):
    head = "rules\n[9] (max ~5 chars) not content\n=== NỘI DUNG CẦN DỊCH ===\n"
    p = spark.createDataFrame([(1, head + "[1] (max ~44 chars) plain text \n\n[2] (table cell, max ~20 chars) cell\nmore\n[3] (caption, max ~ 10 char) c\n[3] (max ~11 chars) again\n[4, caption, max 9 chars] no"), (2, "[1] (max ~4 chars) no mark")], "id long, text string")
    assert sorted(map(tuple, latex.budgets(p).collect())) == [(1, 1, 44, 10, "plain"), (1, 2, 20, 4, "table"), (1, 3, 11, 5, "plain")]
    bands = spark.createDataFrame([(n,) for n in (20, 21, 50, 51, 150, 151, 400, 401)], "n int").select(latex.budget_band(F.col("n")))
    assert [r[0] for r in bands.collect()] == ["1-20", "21-50", "21-50", "51-150", "51-150", "151-400", "151-400", ">400"]
    told = spark.createDataFrame([(1, "plain", 10, 12), (2, "plain", 10, 15), (3, "table", 10, 20), (4, "table", 10, 25), (5, "plain", 10, 10), (6, "plain", 10, 0)], "id long, kind string, budget int, n_vi int")
    use = {(r.dimension, r.value): (r.under, r.over) for r in latex.budget_use(told).collect()}
    assert use == {("kind", "plain"): (1, 2), ("kind", "table"): (0, 2), ("budget", "1-20"): (1, 4), ("excess", "0-25%"): (0, 1), ("excess", "50-100%"): (0, 1), ("excess", ">100%"): (0, 2)}
    assert [r.id for r in latex.worst_excess(told, ["id"], 2).collect()] == [4, 3]


def test_terminology_errors(spark):
    terms = spark.createDataFrame([("neural network", "mạng nơ-ron"), ("layer", "lớp")], "en string, vi string")
    rows = [(1, 0, "A Neural Network here", "một mạng nơ-ron"), (2, 0, "A Neural Network layer", "một mạng lưới"), (3, 0, "Neural network", ""), (4, 0, "nothing", "không gì")]
    got = sorted((r.conv_id, r.category, r.severity) for r in scoring.critic_errors(pairs(spark, rows), terms).collect())
    assert got == [(2, "terminology", "minor"), (3, "completeness", "critical")]
    assert {r.conv_id: r.mqm for r in scoring.mqm(pairs(spark, rows), terms).collect()} == {1: 100.0, 2: 99.9, 3: 75.0, 4: 100.0}


def test_placeholders_with_quotes_spaces_and_case(spark):
    kept = ["$x$", "$y$"]
    assert masking.unmask('a `<<MATH_1>>` b `<<math_2>>` c', kept) == "a `$x$` b $y$ c"
    assert masking.unmask("a <<MATH_1>> b", kept) == "a $x$ b" and masking.unmask("'<< math_2 >>'", kept) == "$y$"
    assert masking.unmask("<<MATH_12>> <<MATH_0>>", kept) == "<<MATH_12>> <<MATH_0>>" and masking.unmask("don't <<MATH_1>>", kept) == "don't $x$"


def test_extracted_terms(spark):
    text = "intro\n```glossary\n# note → x\n\"Deep Net\" → 'mạng sâu'\nkey-value store -> kho\nmap → bản đồ\nab → x\nlayer → lớp\nBERT model → \nseeded term → y\n```\nafter → sau khi"
    get = lambda c: [tuple(x) for x in spark.range(1).select(c).first()[0]]
    assert get(responses.strict_term_lines(F.lit(text), F.array(F.lit("seeded term")))) == [("deep net", "mạng sâu"), ("key-value store", "kho"), ("layer", "lớp")]
    assert get(responses.strict_term_lines(F.lit("plain words → từ\nno pair"))) == [("plain words", "từ")]


def test_failed_chunks_count_as_empty(spark):
    failed = spark.createDataFrame([(1, 3), (1, 7)], "conv_id long, idx long")
    got = diagnostics.findings(pairs(spark, []), failed).collect()
    assert [(r.cause, r.affected, r.severity, r.confidence) for r in got] == [("EMPTY_TRANSLATION", [3, 7], "critical", 0.72)]
    fine = [(1, 0, "Hello world test sentence long enough.", "Xin chào thế giới câu kiểm tra đủ dài.")]
    assert diagnostics.findings(pairs(spark, fine)).count() == 0


def test_glossary_drift_by_hand(spark):
    terms = spark.createDataFrame([("layer", "lớp", 1, False), ("model", "mô hình", 2, False)], "en string, vi string, ordinal long, locked boolean")
    rows = [(1, 0, "a layer", "một layer"), (1, 1, "layer and model", "layer và model"), (1, 2, "layer", "lớp"), (2, 0, "layer", "layer")]
    got = [tuple(r) for r in glossary.drift(glossary.matches(pairs(spark, rows), terms)).collect()]
    assert got == [(1, "layer", 2, [0, 1], 0.61)]
