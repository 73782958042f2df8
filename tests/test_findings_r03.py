"""Small cases for the findings of round 3; each failed before its finding was settled."""

import datetime
import random
import time

from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.operators import chunking, convert, events, geometry, latex, masking, progress, quality, retrieval, segments, state, tables


def test_all_low_rows_are_given(spark, tmp_path):
    spark.range(200).selectExpr("id as o_orderkey", "cast(if(id < 120, id, 30000 + id) as double) as o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(r.o_orderkey for r in state.QUERIES["low_quality_pairs"](spark, str(tmp_path)).collect()) == list(range(120))
    rows = spark.createDataFrame([(1, 60.0), (2, None)], "id long, score double")
    assert state.low_quality(rows, 50.0).count() == 2 and state.low_quality(rows.limit(0), 50.0).count() == 0


def test_a_later_attempt_must_be_better_by_a_tenth(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, at, 7, 1, 50.0), (2, at, 7, 1, 50.05), (3, at, 7, 2, 40.0), (4, at, 7, 2, 40.2), (5, at, 8, 1, 10.0), (6, at, 8, 1, 10.1), (7, at, 9, 1, None)]
    log = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, user_id long, k long, value double")
    got = {r.user_id: r.last_best_seq for r in events.eval_report(log).collect()}
    assert got == {7: 4, 8: 5, 9: None}
    only = events.eval_report(log.where("k = 1")).where("user_id = 7").first()
    assert (only.last_best_seq, only.avg_best) == (1, 50.05)


def test_a_score_at_the_threshold_is_found(spark):
    # chunk 2 knows one of the 64 tokens of chunk 1, which are all new there: 1 / 8 + 0.05 / 2
    texts = lambda n: ["z", " ".join([f"a{i}" for i in range(64 - 4 * n)] + [f"b{i}" for i in range(n) for _ in range(2)]), "a0 new" + " other" * n]
    rows = spark.createDataFrame([(n, i, t) for n in range(15) for i, t in enumerate(texts(n))], "conv_id long, idx long, src string")
    assert sorted((r.conv_id, r.chunk, r.found, r.score) for r in retrieval.memory(rows).collect()) == [(n, 2, 1, 0.15) for n in range(15)]


def test_tables_stay_where_they_are(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "concat('Same words ', id % 7, ' and ', id % 40, ' same') as text")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    # no table is copied: it meets the queries where it lies
    assert "CoGroups" not in plan(retrieval.tfidf_top(docs)) and "CoGroups" not in plan(retrieval.embedding_top(docs.selectExpr("doc_id as vec_id", "array(doc_id + 1.0D, 2.0D) as embedding")))


def test_counts_are_exchanged_by_token_alone(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "concat('Same words ', id % 7, ' and ', id % 40, ' same') as text")
    plan = retrieval.vocabulary(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate [" in x and "doc_id" in x and "token" in x]
    assert [tuple(r) for r in retrieval.vocabulary(docs, 3).collect()] == [("and", 300, 1.0), ("same", 300, 1.0), ("words", 300, 1.0)]


def test_documents_are_parsed_once(spark):
    rows = spark.createDataFrame([("a", '{"status": "done"}'), ("b", "[1]"), ("c", "no"), ("d", None), ("e", "{}")], "job_id string, json string")
    jobs = progress.job_rows(progress.read(rows))
    assert {r.job_id: r.status for r in jobs.collect()} == {"a": "done", "e": "unknown"}
    assert jobs._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_sources_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    sources = spark.createDataFrame([("j", None, True, 0, "t"), ("j", "a.tex", False, 0, "u")], "job_id string, path string, is_main boolean, idx int, text string").mapInArrow(count, "job_id string, path string, is_main boolean, idx int, text string")
    asked = spark.createDataFrame([("j", "0", "latex"), ("j", "input:a.tex:0", "latex"), ("j", "input:b.tex:0", "latex")], "job_id string, chunk_key string, source_type string")
    got = {r.chunk_key: (r.text, r.problem) for r in progress.originals(asked, sources).collect()}
    assert got == {"0": ("t", None), "input:a.tex:0": ("u", None), "input:b.tex:0": (None, "no_file")}
    assert made.value <= 4  # a checkpoint is counted, then written


def test_texts_go_to_python_some_hundred_at_once(spark):
    # Arrow batches hold 10,000 rows
    row_by_row = 100
    assert {f.evalType for f in (convert.markdown_column, convert.html_column, latex.blocks_column, latex.mended_column, masking.masked)} == {row_by_row}
    texts = spark.createDataFrame([(0, None), (1, "# A\n\n$x$ and $y$")], "doc_id long, text string")
    assert [len(r.b) for r in texts.orderBy("doc_id").select(latex.blocks_column("text").alias("b")).collect()] == [len(latex.split_blocks("")), len(latex.split_blocks("# A\n\n$x$ and $y$"))]
    assert [r.restored for r in masking.protected(texts).collect()] == [True, True]


def test_lines_of_a_block_are_made_once(spark):
    lines = F.transform(F.sequence(F.lit(0), F.col("id") % 3), lambda i: F.struct((i * 5.0).alias("x0"), F.lit(90.0).alias("x1")))
    df = spark.range(6).select("id", geometry.block_format(lines, F.lit(0.0), F.lit(100.0), F.lit(600.0)).alias("f"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("sequence(") <= 2  # starts and ends
    assert [(r.f.align, r.f.indent) for r in df.orderBy("id").collect()] == [(0, 0.0), (0, 0.0), (2, 0.0)] * 2


BLOCK = "page_num long, block_idx long, x0 double, y0 double, x1 double, y1 double, text string, translated string, translatable boolean, bold boolean"


def test_boxes_meet_once_and_without_a_grid(spark):
    rng = random.Random(7)
    place = lambda: (x := rng.randrange(0, 900), y := rng.randrange(0, 900), x + rng.randrange(0, 160), y + rng.randrange(0, 160))
    left, right = ([(p, i, *map(float, place())) for p in (1, 2) for i in range(n[p])] for n in ({1: 90, 2: 90}, {1: 9, 2: tables.FEW + 1}))
    meets = lambda a, b: max(a[2], b[2]) < min(a[4], b[4]) and max(a[3], b[3]) < min(a[5], b[5])
    frame = lambda rows: spark.createDataFrame(rows, "page_num long, id long, x0 double, y0 double, x1 double, y1 double")
    met = tables.meeting(frame(left), frame(right))  # the second page is crowded
    assert sorted((r.page_num, r.l.id, r.r.id) for r in met.collect()) == sorted((a[0], a[1], b[1]) for a in left for b in right if a[0] == b[0] and meets(a, b))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" in plan(met) and "explode" not in plan(tables.meeting(frame(left), frame(right[:9])))


def test_tables_of_blocks_stay_where_they_met(spark):
    rng = random.Random(8)
    text = lambda: rng.choice([" First  cell", "First cell", "Third one", "(a)", "b", "", None, "words in a cell"])
    rows = [(p, i, x := rng.randrange(8) * 50.0, y := rng.randrange(9) * 11.0, x + 30, y + 10, text(), rng.choice([None, "", "một\nô", "hai", "First cell"]), rng.random() < 0.7, rng.random() < 0.2) for p in range(40) for i in range(rng.randrange(30))]
    blocks = spark.createDataFrame(rows, BLOCK)
    rects = spark.createDataFrame([(p, k, 180.0 * k - 190, 0.0, 180.0 * k, 60.0) for p in range(40) for k in (1, 2)], "page_num long, table_idx int, x0 double, y0 double, x1 double, y1 double")
    cells = tables.within(blocks, rects).select("page_num", F.col("r.table_idx").alias("table_idx"), "l.block_idx", "l.x0", "l.y0", "l.text")
    told = lambda df: sorted(map(str, df.select("page_num", "table_idx", "data", "trans", "header_bold").collect()))
    got = tables.translated_blocks(rects, blocks)
    assert told(got) == told(tables.translated_tables(rects, tables.laid_out(cells), blocks)) and 20 < got.count() < 80
    real = got.select(tables.looks_real(F.col("data"), F.col("trans")).alias("real"))
    assert real.where("not real").isEmpty()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_drawings_of_many_pages_are_found_together(spark):
    rng = random.Random(9)
    sizes = [0, 1, 2, 3, 3, 4, 7, geometry.SMALL, geometry.SMALL + 1] * 4
    rows = [(p, x := rng.random() * n * 60, y := rng.random() * 300, x + rng.random() * 70, y + rng.random() * 40) for p, n in enumerate(sizes) for _ in range(n)]
    want = []
    for p in range(len(sizes)):
        b = [r[1:] for r in rows if r[0] == p and r[3] - r[1] >= 2 and r[4] - r[2] >= 2]
        left = set(range(len(b)))
        while left:
            group, seen = set(), [left.pop()]
            while seen:
                i = seen.pop()
                group.add(i)
                more = {j for j in left if b[j][0] < b[i][2] + 30 and b[j][2] > b[i][0] - 30 and b[j][1] < b[i][3] + 30 and b[j][3] > b[i][1] - 30}
                left, seen = left - more, seen + list(more)
            x0, y0, x1, y1 = (f(b[i][k] for i in group) for f, k in ((min, 0), (min, 1), (max, 2), (max, 3)))
            want += [(p, x0 - 4, y0 - 4, x1 + 4, y1 + 4)] if len(group) >= 3 and x1 - x0 >= 80 and y1 - y0 >= 80 else []
    frame = spark.createDataFrame(rows, "page_num long, x0 double, y0 double, x1 double, y1 double")
    assert sorted(map(tuple, geometry.diagrams(frame).collect())) == sorted(want) and len({w[0] for w in want}) > 4


def test_room_below_joins_crowded_pages_alone(spark):
    rng = random.Random(10)
    sizes = [1, 5, 9, geometry.FEW, geometry.FEW + 1, 150]
    rows = [(p, i, x := rng.randrange(0, 400) * 1.0, y := rng.randrange(0, 60) * 12.0, x + rng.choice([0, 40, 90, 200]), y + rng.choice([0, 10, 22])) for p, n in enumerate(sizes) for i in range(n)]
    rows += [(None, 1, 0.0, 0.0, 9.0, 9.0), (None, 2, 0.0, 10.0, 9.0, 19.0), (0, 7, None, 30.0, 40.0, 50.0)]
    frame = spark.createDataFrame(rows, "page_num long, block_idx long, x0 double, y0 double, x1 double, y1 double")

    def room(a):
        most = a[5] + 2 * (a[5] - a[3])
        tops = [b[3] for b in rows if a[0] == b[0] is not None and a[1] != b[1] and None not in (a[2], b[2]) and b[3] > a[5] and min(a[4] - a[2], b[4] - b[2]) > 0 and (min(a[4], b[4]) - max(a[2], b[2])) / min(a[4] - a[2], b[4] - b[2]) > 0.3]
        return min([most, *(y - 1.5 for y in tops)])

    got = geometry.room_below(frame)
    assert got.columns == [*frame.columns, "max_y"]
    assert sorted((str(r.page_num), r.block_idx, r.max_y) for r in got.collect()) == sorted((str(a[0]), a[1], room(a)) for a in rows)
    parts = got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "collect_list" in parts and "explode" not in parts  # what is not joined


def test_all_white_space_is_stripped_from_the_ends_alone(spark):
    code = F.explode(F.sequence(F.lit(1), F.lit(0xD7FF))).alias("code")
    text = F.decode(F.unhex(F.lpad(F.hex("code"), 4, "0")), "UTF-16BE")
    rows = spark.range(1).select(code).select(text.alias("c")).select(F.explode(F.array("c", F.concat("c", F.lit("a b"), "c", "c"), F.concat(F.lit("x"), "c", F.lit("y\n　")))).alias("x"))
    same = rows.where(X.strip(F.col("x")) != F.regexp_replace("x", X.STRIP, ""))
    assert rows.count() == 3 * 0xD7FF and same.isEmpty()
    nothing = spark.createDataFrame([(None,), ("",)], "x string").select(X.strip(F.col("x")).alias("x"))
    assert [r.x for r in nothing.collect()] == ["", ""] and "regexp" not in nothing._jdf.queryExecution().optimizedPlan().toString()


def test_sections_are_packed_in_their_rows(spark):
    body = "\n\n".join(["a" * 30, " ", "b" * 25, "c" * 70, "d", "e"])
    docs = spark.createDataFrame([(1, f"intro\n# H\n{body}\n# I\nshort"), (2, None)], "doc_id long, text string")
    chunks = chunking.markdown_chunks(docs, 60)
    got = sorted((r.doc_id, r.section, r.chunk, r.heading, r.text) for r in chunks.collect())
    assert got == [(1, 0, 0, "", "intro"), (1, 1, 0, "# H", "a" * 30 + "\n\n" + "b" * 25), (1, 1, 1, "# H", "c" * 70), (1, 1, 2, "# H", "d\n\ne"), (1, 2, 0, "# I", "short")]
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Union" not in plan


def test_pieces_are_packed_over_batches(spark):
    sizes = {(d, p): random.Random(d * 7 + p).choices(range(40), k=500) for d in range(12) for p in (0, 1)}
    rows = spark.createDataFrame([(d, p, i, n) for (d, p), ns in sizes.items() for i, n in enumerate(ns)], "doc_id long, part int, piece int, n int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.doc_id, r.part, r.piece): r.chunk for r in chunking.packed(rows, F.col("n"), 100).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(d, p, i): c for (d, p), ns in sizes.items() for i, c in enumerate(segments.greedy(ns, 100))}
    assert not hasattr(chunking, "Pack")  # no row goes to Python alone


def test_classes_tell_ascii_apart_first(spark):
    code = F.explode(F.sequence(F.lit(1), F.lit(0xD7FF))).alias("code")
    rows = spark.range(1).select(code).select(F.decode(F.unhex(F.lpad(F.hex("code"), 4, "0")), "UTF-16BE").alias("c"))
    pairs = ((X.VIETNAMESE_CLASS, f"[{X.VIETNAMESE}]"), (X.MATH_CLASS, f"[{X.MATH_SYMBOLS}]"), (X.TOKEN_RUN, X.TOKEN))
    differ = rows.select(*(F.sum((F.col("c").rlike(a) != F.col("c").rlike(b)).cast("int")) for a, b in pairs), *(F.sum(F.col("c").rlike(a).cast("int")) for a, _ in pairs)).first()
    n_math = len(set(X.MATH_SYMBOLS.replace("\\", "")))
    assert tuple(differ) == (0, 0, 0, len(set(X.VIETNAMESE)), n_math, 0xD7FF - len(X.SPACES))


def test_kept_symbols_are_sought_once(spark):
    rows = spark.createDataFrame([(1, 1, "1 + 2 = 3, 1 and 10 + 1", "1 + 3"), (1, 2, "no numbers", "5 = 5"), (2, 1, "", "7"), (2, 2, "7 - 7", "")], "conv_id long, idx long, src string, mt string")
    sums = quality._sub_scores(rows, "conv_id")
    got = {r.conv_id: (r.nums, r.nums_kept, r.syms, r.syms_kept) for r in sums.collect()}
    assert got == {1: (6, 4, 3, 2), 2: (0, 0, 0, 0)}
    long_ = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(1).alias("idx"), F.repeat(F.lit("1 + "), 20_000).alias("src"), F.repeat(F.lit("2 = 1 "), 20_000).alias("mt"))
    began = time.time()
    assert quality._sub_scores(long_, "conv_id").first().nums_kept == 20_000
    assert time.time() - began < 60  # some 0.8 milliseconds a number and symbol if the translation is searched for each
