"""Pages, revisits, conversations, benchmark leaks and the pipeline."""

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import chat, decontaminate, html_text, warc

PAGE = (
    "<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li><li>News</li></ul></nav>"
    "<div class=\"ad\">Buy now {i}</div><div class='cookie-notice'>We use cookies</div><article><h1>Title {i} &lt;b&gt;</h1><p><b>Bold {i}.<br><p>Text  of\n the <i>page</i>{i}, caf&eacute;.</p>"
    "<section class=\"comments\"><p>nice post {i}</p></section></article><aside>Links</aside><form><input name=q><button>Go</button></form><footer>&copy; {i}</footer></body></html>"
)


def test_blocks_decode_and_collapse():
    found = [t for t, _ in html_text.blocks(PAGE.format(i=3))]
    assert found == ["Home", "News", "Buy now 3", "We use cookies", "Title 3 <b>", "Bold 3.", "Text of the page3, café.", "nice post 3", "Links", "Go", "© 3"]
    assert html_text.blocks("") == [] and [t for t, _ in html_text.blocks("a <b")] == ["a"]
    assert [t for t, _ in html_text.blocks("x<!-- <p>no</p> -->y &am &ampz <p")] == ["xy &am &z"]


TEXTS = [
    ("<head><title>x</title><body><article><p>Hello there", ["Hello there"]),
    ("<svg><path d='1'><p>after", ["after"]),
    ("<select><option>a<option>b<p>after", ["after"]),
    ("<iframe src=x><p>after", ["after"]),
    ("<title>no end<p>text", ["text"]),
    ("<textarea>no end<p>text", ["text"]),
    ("<title>a <p> b</title><p>c", ["c"]),
    ('<p class="x>Hello there friend', ["Hello there friend"]),
    ('<p class="x>Hello</p><p class="y">Two</p><div id="z">three', ["Hello", "Two", "three"]),
    ("<p title='a > b'>ok</p>", ["ok"]),
    ('<p data-x="<b>bold</b>">ok</p>', ["ok"]),
    ("<p a=b'c>d</p><p e='f'>g", ["d", "g"]),
    ("<p>let <math><mi>x</mi><annotation>T</annotation></math> be", ["let x be"]),
    ("<table><tr><td>1<td>2<tr><td>3<th>4</table>x", ["1", "2", "3", "4", "x"]),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<head>stray<p>x", ["stray", "x"]),
    ("<head><noscript><img src=a></noscript><meta x><title>t</title></head><p>b", ["b"]),
    ("<p>a<noscript><div>hid</div></noscript>b<svg><foreignObject><div>hid</div></foreignObject></svg>c", ["abc"]),
]


@pytest.mark.parametrize("page, texts", TEXTS)
def test_blocks_of_omitted_and_unbalanced_markup(page, texts):
    assert [t for t, _ in html_text.blocks(page)] == texts


def test_blocks_without_the_end_tags_that_may_be_left_out(spark):
    optional = re.compile(
        r"</(?:li|dt|dd|tr|td|th|thead|tbody|tfoot|option|head|body|html)\s*>|"
        r"</p\s*>(?=\s*(?:</|<(?:p|div|ul|ol|h[1-6]|table|section|article|blockquote|pre|form|nav|aside|footer|header|main|hr|dl|figure)\b))", re.I)  # fmt: skip
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").where("html is not null").limit(200).collect()]
    for page in pages:
        assert [t for t, _ in html_text.blocks(optional.sub("", page))] == [t for t, _ in html_text.blocks(page)]


def test_main_text(spark):
    rows = [(i, f"u{i}", PAGE.format(i=i), "k") for i in range(60)] + [(100, None, None, "k"), (101, "u", "", "k"), (102, "u", "<nav>only</nav>", "k"), (None, "u", PAGE.format(i=7), "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.main_text(pages).collect()}
    assert len(got) == 64
    for i in range(60):
        want = f"Title {i} <b>\nBold {i}.\nText of the page{i}, café."
        assert got[i].text == want and got[i].n_chars == len(want)
    assert got[100].text == got[101].text == got[102].text == "" and got[None].text.startswith("Title 7")
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_labeller_held_out_accuracy_and_context():
    pages = [html_text.blocks(PAGE.format(i=i)) for i in range(80)]
    labels = [html_text.labels(b).astype(np.float32) for b in pages]
    made = html_text.Labeller().fit([html_text.vectors(b) for b in pages[:50]], labels[:50])
    got = made.label([html_text.vectors(b) for b in pages[50:]])
    assert all((g == y.astype(bool)).all() for g, y in zip(got, labels[50:], strict=True))
    assert [g.tolist() for g in made.label([html_text.vectors(b) for b in pages[50:52]])] == [g.tolist() for g in got[:2]]


BARE = (  # nothing here is named as main text
    "<body><div class=top><a href=/>Home</a> <a href=/n>News</a></div><div id=wrap><div class=story><h2>Heading {i}</h2><p>{a}</p><p>{b}</p><ul><li>Short point {i}</li></ul></div></div>"
    "<div class=sidebar><p>Read our other fine stories about many other things here today</p></div><div class=bottom>Imprint</div></body>"
)


def test_pages_without_named_main_text(spark):
    rng = np.random.default_rng(1)
    prose = lambda: " ".join(rng.choice("river stone walks under old bridge while people watch boats move slowly".split(), 25)) + "."
    rows, want = [], {}
    for i in range(60):
        a, b = prose(), prose()
        rows.append((i, f"u{i}", BARE.format(i=i, a=a, b=b)))
        want[i] = f"Heading {i}\n{a}\n{b}\nShort point {i}"
    found = html_text.blocks(rows[0][2])
    assert [t for (t, _), y in zip(found, html_text.labels(found), strict=True) if y] == want[0].split("\n")
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_sample_of_pages_is_bounded(spark, monkeypatch):
    rows = [(i % 40, f"u{i}", PAGE.format(i=i)) for i in range(120)] + [(99, "u", "<p>x</p>" * 7_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sizes = []
    monkeypatch.setattr(html_text.Labeller, "fit", lambda self, xs, ys: sizes.append((len(xs), sum(map(len, xs)))) or self)
    html_text.trained(pages, sample=30)
    html_text.trained(pages, sample=30, sample_blocks=150)
    assert sizes[0] == (30, 330) or sizes[0] == (29, 319)
    assert sizes[1] == (13, 143)
    assert html_text.trained(pages.limit(0)).p.keys() == html_text.Labeller().p.keys() and len(sizes) == 2


def test_deep_and_unclosed_markup_takes_time_in_proportion():
    import time

    began = time.time()
    page = "<i>" * 50_000 + "</u>" * 50_000 + "text" + "<div></div>" * 20_000 + "<p>a" * 20_000 + "<span>" * 50_000 + "b"
    found = html_text.blocks(page)
    assert [t for t, _ in found[:2]] == ["text", "a"] and found[-1][0] == "ab" and len(found) == 20_001
    assert html_text.vectors(found[:100]).shape == (100, html_text.DIM) and len(html_text.labels(found)) == len(found)
    assert time.time() - began < 20


def test_labeller_gradient():
    made, rng = html_text.Labeller(), np.random.default_rng(0)
    pages = [rng.normal(0, 1, (n, html_text.DIM)).astype(np.float32) for n in (5, 3)]
    x, live = html_text.padded(pages)
    y = rng.integers(0, 2, x.shape[:2])
    made.p = {k: v.astype(np.float64) for k, v in made.p.items()}

    def loss():
        z = made.scores(x, live)[0]
        return float((np.logaddexp(0, z) - y * z)[live].sum())

    z, seen, tf, tb = made.scores(x, live, True)
    dz = np.where(live, html_text._sigmoid(z) - y, 0)
    grad = {}
    made._back(x, dz[:, :, None] * made.p["out"][: html_text.HIDDEN], tf, "f", grad)
    for name in ("Wf", "Uf", "cf"):
        at = tuple(int(rng.integers(n)) for n in made.p[name].shape)
        made.p[name][at] += 1e-3
        up = loss()
        made.p[name][at] -= 2e-3
        down = loss()
        made.p[name][at] += 1e-3
        assert grad[name][at] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=2e-3)


def conversation(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")


def test_chat_collapses_snapshots(spark):
    said = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    logs = {1: said[:2], 2: said, 3: said[:3], 4: said, 5: [("user", "a"), ("assistant", "other")], 6: [("user", None)], 7: [(None, "")], 8: said[1:]}
    rows = [(i, 10 * k, r, t, 0) for i, turns in logs.items() for k, (r, t) in enumerate(turns)] + [(None, 0, "user", "a", 0)]
    got = {r.conv_id: r for r in chat.rendered(conversation(spark, rows)).collect()}
    assert sorted(got) == [2, 5, 6, 7, 8]
    assert got[2].n_copies == 2 and got[2].n_turns == 4
    assert got[5].text == "<|user|>\na\n<|end|>\n<|assistant|>\nother\n<|end|>\n"
    assert got[6].text == "<|user|>\n\n<|end|>\n" and got[7].text == "<|unknown|>\n\n<|end|>\n"
    assert chat.rendered(conversation(spark, rows).limit(0)).count() == 0


def test_chat_order_matters_and_repeated_turns_stay(spark):
    rows = [(1, 0, "user", "x", 0), (1, 1, "user", "y", 0), (2, 0, "user", "y", 0), (2, 1, "user", "x", 0), (3, 0, "user", "x", 0), (3, 0, "user", "x", 0)]
    got = {r.conv_id: r.n_turns for r in chat.rendered(conversation(spark, rows)).collect()}
    assert got == {1: 2, 2: 2, 3: 2}


def records(spark, rows):
    return spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>, outcome string")


def test_revisits(spark):
    day = 86_400
    rows = [
        (1, "http://www.A.com/x/", 10, 200, {"etag": '"0"', "ETag": '"1"', "Content-Length": "9", "X": "old"}, ""),
        (2, "https://a.com/x#f", 5 * day, 304, {"etag": 'W/"1"', "content-length": "0", "x": "new"}, ""),
        (3, "https://a.com/x?utm_source=q", 6 * day, 200, {"ETag": '"2"'}, ""),
        (4, "a.com/x", 6 * day, 304, {"etag": '"2"'}, ""),
        (5, "a.com/x", 6 * day + 1, 304, {"etag": '"1"'}, ""),
        (6, "b.com/y?ref=z&k=1", 7, 304, {"etag": '"1"'}, ""),
        (7, "a.com/x", 5, 304, {"etag": '"1"'}, ""),
        (8, None, 5, 304, None, ""),
        (9, "c.com", 1, 200, {"Last-Modified": "m"}, ""),
        (10, "c.com/", 2, 304, {"last-modified": "m", "etag": '"z"'}, ""),
        (11, "c.com/", None, 304, {"last-modified": "m"}, ""),
        (12, "c.com", 2, 404, None, ""),
    ]
    got = {r.record_id: r for r in warc.resolve(records(spark, rows)).collect()}
    told = {i: (r.outcome, r.refers_to) for i, r in got.items()}
    assert told == {1: ("full", 1), 2: ("resolved", 1), 3: ("full", 3), 4: ("resolved", 3), 5: ("mismatch", None), 6: ("no_earlier", None), 7: ("no_earlier", None), 8: ("no_earlier", None), 9: ("full", 9), 10: ("resolved", 9), 11: ("no_earlier", None), 12: ("full", 12)}
    assert got[2].merged_headers == {"content-length": "9", "etag": 'W/"1"', "x": "new"}
    assert got[6].canonical_url == "b.com/y?k=1"
    assert warc.resolve(records(spark, rows).limit(0)).count() == 0
    own = records(spark, rows).withColumns({"canonical_url": F.lit("own"), "near": F.lit(1), "__url": F.lit("kept"), "outcome": F.lit(2)})
    found = warc.resolve(own)
    assert sorted(found.columns) == sorted([*own.columns, "refers_to", "merged_headers"]) and {r.outcome for r in found.collect()} == {r.outcome for r in got.values()}
    assert {(r.near, r["__url"]) for r in found.collect()} == {(1, "kept")}


def test_revisits_of_records_without_a_url_or_id_and_ties(spark):
    rows = [(None, None, 5, 304, {"etag": "a"}), (None, None, 5, 200, {"etag": "a"}), (7, None, 6, 304, None)]
    rows += [(1, "http://x/", 1, 200, {"etag": "a"}), (1, "http://x/", 1, 200, {"etag": "b"}), (2, "http://x/", 2, 304, {"etag": "a"}), (3, "http://x/", 2, 304, {"etag": "b"})]
    frame = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>")
    told = lambda df: sorted((str(r.record_id), r.status, r.outcome, str(r.refers_to)) for r in warc.resolve(df).collect())
    first = told(frame)
    assert first == told(frame.orderBy(F.desc("ts"), "headers.etag").repartition(3)) and len(first) == len(rows)
    assert sorted(o for _, status, o, _ in first if status == 304) == ["mismatch", "no_earlier", "no_earlier", "resolved"]


BENCH = [
    (1, "The quick train left the old station at 9 km from Paris with 12 wagons and 9 doors today"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (3, None),
    (4, "short one here"),
]


def leak(spark, texts):
    docs = spark.createDataFrame([(i + 1, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, BENCH[1][1], "en", "s", 0)], "doc_id long, text string, lang string, item_id string, n_chars long")
    return docs, spark.createDataFrame(BENCH, "item_id long, text string")


def test_decontamination(spark):
    texts = [
        "We saw it. " + BENCH[0][1] + " And then nothing.",
        "x y z " + BENCH[0][1].replace("9", "7").replace("Paris", "Lyon").replace("12", "30") + " w",
        "x y z " + BENCH[0][1].replace("9 km", "7 km") + " w",  # one value of the item becomes two
        "pre " + BENCH[1][1].upper() + ", post",
        "alpha beta gamma delta epsilon",
        None,
        "",
        "a short one here now",
        "lambda mu alpha beta gamma delta epsilon zeta eta theta iota kappa",
        "filler " * 3000 + BENCH[1][1],
    ]
    docs, bench = leak(spark, texts)
    got = {r.doc_id: (r.contaminated, list(r.item_ids), r.reworded) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got[1] == (True, [1], False) and got[2] == (True, [1], True) and got[3] == (False, [], False)
    assert got[4] == (True, [2], False) and got[10] == (True, [2], False)
    assert got[8] == (True, [4], False)  # all three tokens of a short item in a row
    assert not any(got[i][0] for i in (5, 6, 7, None)) and got[9][1] in ([], [2])
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} >= {3, 5, 6, 7, None}
    assert decontaminate.contaminated(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_decontamination_finds_items_with_words_put_in_or_left_out(spark):
    words = [f"w{i}x" for i in range(40)]
    plain = " ".join(words)
    slotted = " ".join([*words[:10], "99", *words[10:30], "99", *words[30:]])
    put_in = lambda t, n=1: " ".join([*t.split()[:20], *["new"] * n, *t.split()[20:]])
    texts = [f"before it {put_in(plain)} after", f"before it {' '.join(words[:20] + words[21:])} after", put_in(slotted), put_in(slotted).replace("99", "30"), put_in(slotted).replace("99", "30", 1), put_in(plain, decontaminate.BAND + 1)]
    docs, _ = leak(spark, texts)
    bench = spark.createDataFrame([(1, plain), (2, slotted)], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, list(r.item_ids), r.reworded) for r in decontaminate.contaminated(docs, bench.where("item_id = 1")).collect()}
    assert got[1] == got[2] == (True, [1], False) and got[6] == (False, [], False)
    got = {r.doc_id: (r.contaminated, list(r.item_ids), r.reworded) for r in decontaminate.contaminated(docs, bench.where("item_id = 2")).collect()}
    assert got[3] == (True, [2], False) and got[4] == (True, [2], True) and got[5] == (False, [], False)


def test_decontamination_of_short_and_repeated_items(spark):
    bench = spark.createDataFrame([(1, "blue"), (2, "deep blue sea"), (3, "one two three four five"), (4, "a b c d e f g"), (4, "t u v w x y z"), (4, None), (4, "a b c d e f g"), (None, "deep"), (5, "five")], "item_id long, text string")
    texts = ["the deep blue sea is here", "Deep, blue; sea.", "blue", "sea blue deep", "x one two three four five y", "one two three four", "z a b c d e f g", "z t u v w x y z y", "deep"]
    docs, _ = leak(spark, texts)
    got = {r.doc_id: list(r.item_ids) for r in decontaminate.contaminated(docs, bench).collect()}
    assert [got[i] for i in range(1, 10)] == [[1, 2], [1, 2], [1], [1], [3, 5], [], [4], [4], []]
    twice = docs.unionByName(docs)
    assert sorted((r.doc_id or 0, tuple(r.item_ids)) for r in decontaminate.contaminated(twice, bench).collect()) == sorted((k or 0, tuple(v)) for k, v in got.items() for _ in range(2))


def test_decontamination_of_renamed_and_lower_case_questions(spark):
    item = "Tom has 5 apples. Tom gives 2 to Anna. How many apples does Tom have left?"
    swap = lambda **names: re.sub("|".join(names), lambda m: names[m[0]], item)
    texts = [item, item.lower(), item.upper(), swap(Tom="Ben"), swap(Tom="ben", Anna="eva").lower(), swap(Tom="Ben", Anna="Eva").replace("5", "7"), item.replace("Tom gives", "Ben gives")]
    texts += [f"before it, and {swap(Tom='Ben')} after it", item.replace("apples", "pears"), "Tom and Anna have left.", "has many apples and gives does"]
    docs, _ = leak(spark, texts)
    bench = spark.createDataFrame([(1, item), (2, "How To Cook A Good Meal At Home"), (3, "Anna Smith")], "item_id long, text string")
    got = {r.doc_id: (list(r.item_ids), r.reworded) for r in decontaminate.contaminated(docs, bench).collect()}
    assert [got[i] for i in range(1, 9)] == [([1], False)] * 3 + [([1], True)] * 3 + [([], False), ([1], True)]
    assert all(got[i] == ([], False) for i in (9, 10, 11))


def brute_leaks(docs, bench):
    """Documents with 0.8 of an item's windows on one alignment, slots consistent; the windows laid on every place of the document."""
    token = re.compile(r"[^\W_]+(?:[.,'’-][^\W_]+)*[.!?:]?")
    bare = lambda w: w.rstrip(".!?:")

    def template(ws):
        num = [w[0] in "0123456789" for w in ws]
        return ["<num>" if num[i] else "<unit>" if i and num[i - 1] and bare(w).lower() in decontaminate.UNITS else bare(w).lower() for i, w in enumerate(ws)]

    def names(ws):
        capital = lambda w: "A" <= w[0] <= "Z" or ord(w[0]) > 127 and bare(w).lower() != bare(w)
        return {bare(w).lower() for i, w in enumerate(ws) if i and capital(w) and ws[i - 1][-1] not in ".!?:" and len(bare(w)) > 1 and bare(w).upper() != bare(w)}

    found = set()
    for d, text in docs.items():
        dw = token.findall(text or "")
        dt = template(dw)
        for item, version in bench:
            bw = token.findall(version or "")
            bt, k = template(bw), min(5, len(bw))
            called = names(bw)
            wild = [k == 5 and t[0] != "<" and bare(w).lower() in called for t, w in zip(bt, bw)]
            n = len(bt) - k + 1
            for shift in range(-len(bt), len(dt)) if k else ():
                at = lambda p: dt[p + shift] if 0 <= p + shift < len(dt) else None  # noqa: E731, B023
                loose = lambda i: sum(wild[i : i + k]) <= 2  # noqa: E731, B023
                hits = [i for i in range(n) if all(at(p) == bt[p] or wild[p] and loose(i) and at(p) is not None for p in range(i, i + k))]
                if len(hits) < 0.8 * n:
                    continue
                values = {}
                for p, t in enumerate(bt):
                    if wild[p] and any(i <= p < i + k for i in hits) or t[0] == "<" and at(p) == t:
                        values.setdefault(("<name>" if wild[p] else t, bare(bw[p]).lower()), set()).add(bare(dw[p + shift]).lower())
                if all(len(v) == 1 for v in values.values()):
                    found.add((d, item))
    return found


def test_decontamination_brute_force(spark):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(30)] + ["Rome", "Oslo", "rome", "Bern.", "The", "How", "7", "19", "km", "days", "3.5"]
    text = lambda n: " ".join(rng.choice(words, n))
    bench = [(i, text(int(n))) for i, n in enumerate(rng.integers(1, 40, 30))]
    docs = {}
    for i in range(120):
        _, item = bench[int(rng.integers(30))]
        ws = item.split()
        for at in rng.integers(0, len(ws), int(rng.integers(0, 3))):
            ws[at] = str(rng.choice(words))
        if i % 4 == 0:
            ws = [w.replace("Rome", "Paris") for w in ws]
        ws = [w.lower() for w in ws] if i % 5 == 0 else ws
        docs[i + 1] = f"{text(int(rng.integers(0, 30)))} {' '.join(ws)} {text(int(rng.integers(0, 30)))}"
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {(r.doc_id, i) for r in decontaminate.contaminated(frame, spark.createDataFrame(bench, "item_id long, text string")).collect() for i in r.item_ids}
    want = brute_leaks(docs, bench)
    assert want <= got and len(want) > 40
    assert all(len(bench[i][1].split()) > 5 for _, i in got - want)  # only bands of alignments find more


def test_pipeline_stages_take_effect(spark, tmp_path):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n))
    passage, item = word(80), word(25)
    texts = [word(120), word(130), "too short", f"{word(70)} {passage} {word(60)}", f"{word(70)} {passage} {word(60)}", f"{word(60)} {item} {word(60)}", None]
    texts += [texts[0], "a b c " * 100]
    docs = spark.createDataFrame([(i + 1, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        kept.append(sorted(r.doc_id for r in now.collect()))
    assert kept == [[1, 2, 4, 5, 6, 8], [1, 2, 4, 5, 6], [1, 2, 4, 5, 6], [1, 2, 4, 5]]
    by = {r.doc_id: r for r in now.collect()}
    assert passage in by[4].text and passage not in by[5].text and by[5].n_chars == len(by[5].text) and by[1].text == texts[0]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {1, 2, 4, 5}


class Article(HTMLParser):
    """The article of a page by its tags alone, from the standard library's parser: what the fixture pages are made of."""

    BLOCK = set("article aside blockquote body div dd dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
    OUT = re.compile(r"nav|menu|ad|ads|advert|banner|cookie|notice|comment|comments|sidebar|footer|header|form|share|promo|related|reply|replies")

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.out, self.said = [], [], []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        text = " ".join("".join(self.said).split())
        self.said = []
        if text:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.said.append(" ")
        elif tag not in ("img", "meta", "link", "input", "hr", "source", "wbr"):
            if tag in self.BLOCK:
                self.end()
            names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).split()
            self.open.append((tag, tag in ("nav", "aside", "form", "footer", "header", "script", "style", "noscript", "title", "svg", "select", "textarea", "template", "iframe", "button") or any(self.OUT.fullmatch(p) for n in names for p in re.split("[-_]", n.lower()))))

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.end()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if any(t in ("article", "main") for t, _ in self.open) and not any(out for _, out in self.open):
            self.said.append(data)


def test_main_text_against_the_articles_of_the_fixture_pages(spark):
    """The labeller, told nothing of tags at the time, gives the article of the pages that name one, blocks and all."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    told = [(r.page_id, r.html) for r in pages.collect() if r.html and re.search(r"<(article|main)\b", r.html)]
    blocks = lambda t: Counter(t.split("\n")) if t else Counter()
    want = {i: blocks("\n".join(Article(page).out)) for i, page in told}
    found = {i: blocks(got[i]) for i in want}
    lost, more = (sum(sum((a[i] - b[i]).values()) for i in want) for a, b in ((want, found), (found, want)))
    assert len(want) > 100 and lost + more <= 0.005 * sum(sum(w.values()) for w in want.values()), (lost, more)
