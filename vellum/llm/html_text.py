"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, the runs of text between block-level tags.  Every
block becomes a vector: its tag path (tags, classes and ids, hashed), its words
(hashed) and a few counts.  A bidirectional LSTM in numpy reads the whole sequence
of a page and says for each block whether it is main text, so a block without a
telling path is judged by what stands before and after it.

The labeller is trained here, on at most SAMPLE pages and SAMPLE_BLOCKS blocks, with
labels from the pages' own structure: a block is main text if it is in nothing that is
named as a menu, notice, advert, form or comment, and inside <article> or <main> or, on
pages without either, inside the innermost element that holds nearly all running text.
Parts of the paths are hidden in training so that words and neighbours count too.
Every page is then labelled by the network.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.store import written
from vellum.llm.words import split_words

#: Pages that the labeller is fitted on, at most: those with the least hash of page_id; of these, as many as have so many blocks together.
SAMPLE, SAMPLE_BLOCKS = 300, 60_000
#: Words of a block that counts as running text, and the share of it that the innermost main element holds.
RUNNING_WORDS, NEARLY_ALL = 8, 0.9
PATH_DIM, WORD_DIM, COUNT_DIM, HIDDEN = 96, 32, 6, 16
DIM = PATH_DIM + WORD_DIM + COUNT_DIM
EPOCHS, BATCH_PAGES, RATE, HIDE = 14, 16, 0.02, 0.3
#: Blocks of the pages that are labelled together.
OPEN_BLOCKS = 20_000

# Elements that end a block, that have no content, and whose text is never shown.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style noscript template iframe object svg annotation annotation-xml textarea select title head".split())
# What may stand in a head; elements whose end tags may be left out, with what their start ends and how far up it looks.
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_CELLS, _ROWS, _PARTS = ("td", "th"), ("td", "th", "tr"), ("caption", "td", "th", "tr", "thead", "tbody", "tfoot")
IMPLIED = (
    {"li": (("li",), ("ul", "ol", "menu", "dir")), "option": (("option",), ("select", "datalist", "optgroup")), "optgroup": (("option", "optgroup"), ("select",))}
    | {t: (("dd", "dt"), ("dl",)) for t in ("dd", "dt")}
    | {t: (_CELLS, ("table", "tr")) for t in _CELLS}
    | {"tr": (_ROWS, ("table",))}
    | {t: (_PARTS, ("table",)) for t in ("thead", "tbody", "tfoot")}
)
#: Hidden elements that end where a block begins, should their end tag be missing; those up to whose end tag everything is text.
SOFT, RAW = ("svg", "select", "iframe", "title", "textarea"), ("title", "textarea")
IN_SOFT = frozenset("title option optgroup hr button canvas legend".split())
#: Names that tell what isn't main text, as whole words of tags, classes, ids and roles.
OTHER = re.compile(
    r"(?:^|[-_ ])(nav\w*|menu\w*|header|masthead|banner|footer|foot|aside|sidebar\w*|side|widget\w*|ad|ads|advert\w*|sponsor\w*|promo\w*|popup|modal|"
    r"cookie\w*|consent|notice\w*|alert|gdpr|form|login|signup|subscribe|newsletter|search|comment\w*|respond|disqus|reply|replies|share|sharing|social|"
    r"breadcrumb\w*|pagination|pager|related|recommend\w*|tags|toc|legal|copyright|skip)(?:$|[-_ ])"
)
MAIN = frozenset(("article", "main"))
# An attribute's quoted value begins after = and is followed by a space, an end or the next name; one that holds < or > is short.
# A tag whose quotes don't pair up so ends at its first >.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"'=]|=\s*(?:\"(?:[^\"<>]*|[^\"]{0,2000})\"|'(?:[^'<>]*|[^']{0,2000})')(?=[\s/>]|[\w:-]+=)|=(?!\s*[\"']))*)(?:>|(?=<)|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)(?:>|(?=<)|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Step:
    """An open element: what holds for it and for all that it lies in, so that no path is ever copied."""

    __slots__ = ("tag", "up", "depth", "block_at", "places", "names", "main", "other", "hidden")

    def __init__(self, tag: str, named: str, up: Step | None):
        self.tag, self.up = tag, up
        self.depth = up.depth + 1 if up else 0
        #: Depth of the innermost block element, this one included; -1 without any.
        self.block_at = self.depth if tag in BLOCK_TAGS else up.block_at if up else -1
        self.names = f"{tag} {named}".rstrip()
        own, main, other = _told_by_names(self.names)
        self.places = own | (up.places if up else 0)
        self.main, self.other = main or bool(up and up.main), other or bool(up and up.other)
        self.hidden = tag in HIDDEN_TAGS or bool(up and up.hidden)


@lru_cache(maxsize=50_000)
def _told_by_names(names: str) -> tuple[int, bool, bool]:
    """Places of an element's names in the path vector as bits, whether it is for main text, and whether for something else."""
    words = names.split()
    places = 0
    for w in set(words):
        places |= 1 << zlib.crc32(w.encode()) % PATH_DIM
    return places, words[0] in MAIN or "role-main" in words, any(OTHER.search(w) for w in words)


def blocks(page: str) -> list[tuple[str, Step | None]]:
    """(text, innermost element) of each leaf block in page order; hidden text is left out, white space collapsed.

    End tags that may be left out are supplied.  Takes time in proportion to the page,
    however deep or unclosed its elements are.
    """
    out: list[tuple[str, Step | None]] = []
    stack: list[Step] = []
    depths: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of each name
    said: list[str] = []
    low = page.lower() if any(f"<{t}" in page or f"<{t.upper()}" in page for t in RAW) else ""
    low = low if len(low) == len(page) else "".join(c.lower() if c.isascii() else c for c in page) if low else ""
    unclosed: set[str] = set()
    at = 0

    def end() -> None:
        if said:
            text = " ".join(html.unescape("".join(said)).split())
            said.clear()
            if text:
                out.append((text, stack[-1] if stack else None))

    def leave(depth: int) -> None:
        for step in stack[depth:]:
            depths[step.tag].pop()
        del stack[depth:]

    def say(text: str) -> None:
        if stack and stack[-1].tag == "head" and not text.isspace():  # a head holds no text of its own
            leave(len(stack) - 1)
        if not (stack and stack[-1].hidden):
            said.append(text)

    def supply(tag: str, block: bool) -> None:
        """The end tags that ``tag`` stands for."""
        if depths["head"] and (tag == "body" or tag not in HEAD_TAGS and not any(depths[t] for t in ("noscript", "template", "object", "svg", "title"))):
            leave(depths["head"][0])
        if block and tag not in IN_SOFT and not depths["foreignobject"]:
            open_ = [depths[t][0] for t in SOFT if depths[t]]
            if open_:
                leave(min(open_))
        if tag in IMPLIED:
            ends, within = IMPLIED[tag]
            scope = max((depths[t][-1] for t in within if depths[t]), default=-1)
            inner = [depths[t][k] for t in ends for k in [bisect_right(depths[t], scope)] if k < len(depths[t])]
            if inner:
                leave(min(inner))
        if block and stack and not stack[-1].hidden and stack[-1].block_at >= 0 and stack[stack[-1].block_at].tag == "p":
            leave(stack[-1].block_at)

    while m := _TAG.search(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        closing, tag, rest = m.group(2, 3, 4) if m[3] else m.group(5, 6, 7)
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCK_TAGS
        if tag == "br":
            said.append(" ")
            continue
        covered = bool(stack and stack[-1].hidden)
        if block and not covered:
            end()
        if closing:
            if depths[tag]:
                leave(depths[tag][-1])
            continue
        supply(tag, block)
        if block and covered and not (stack and stack[-1].hidden):
            end()
        if tag in VOID_TAGS:
            continue
        named = " ".join(f"role-{v}" if n.lower() == "role" else v for n, *vs in _NAMED.findall(rest) for v in ["".join(vs)]) if rest else ""
        if not rest.rstrip().endswith("/") or block:
            depths[tag].append(len(stack))
            stack.append(Step(tag, named.lower(), stack[-1] if stack else None))
            if tag in RAW and tag not in unclosed and not depths["svg"]:
                to = low.find(f"</{tag}", at)
                if to < 0:
                    unclosed.add(tag)
                else:
                    at = to  # what looks like tags before is text, and hidden
    if at < len(page):
        say(page[at:])
    end()
    return out


def labels(found: list[tuple[str, Step | None]]) -> np.ndarray:
    """Which blocks the page's own structure says are main text; this is what the labeller learns from.

    Without <article> or <main>, the innermost element that holds nearly all running text
    takes their part, and of other blocks outside it none does.
    """
    good = np.array([not (step and step.other) for _, step in found], bool)
    if any(step and step.main for _, step in found):
        return good & np.array([bool(step and step.main) for _, step in found], bool)
    running = [(len(text), step) for (text, step), g in zip(found, good, strict=True) if g and text.count(" ") >= RUNNING_WORDS - 1]
    total = sum(n for n, _ in running)
    if not total:
        return np.zeros(len(found), bool)
    held: Counter[Step] = Counter()
    for n, step in running:
        held[step] += n
    # sums go up from the deepest element, each once
    for step in sorted(_all_above(held), key=lambda s: -s.depth):
        if step.up:
            held[step.up] += held[step]
    inner = [s for s, n in held.items() if s is not None and n >= NEARLY_ALL * total and s.block_at == s.depth]
    if not inner:
        return good & np.array([text.count(" ") >= RUNNING_WORDS - 1 for text, _ in found], bool)
    home = max(inner, key=lambda s: s.depth)
    home = home.up if home.tag in ("p", "li", "td", "blockquote") and home.up else home
    within: dict[Step | None, bool] = {None: False}
    for step in sorted(_all_above({step: 1 for _, step in found}), key=lambda s: s.depth):
        within[step] = step is home or within[step.up]
    return good & np.array([within[step] for _, step in found], bool)


def _all_above(steps) -> set[Step]:
    """Elements and all that they lie in."""
    seen: set[Step] = set()
    for step in steps:
        while step is not None and step not in seen:
            seen.add(step)
            step = step.up
    return seen


def vectors(found: list[tuple[str, Step | None]]) -> np.ndarray:
    """One row for each block."""
    x = np.zeros((len(found), DIM), np.float32)
    if not found:
        return x
    for i, (_, step) in enumerate(found):
        x[i, :PATH_DIM] = _bits(step.places | 1 << zlib.crc32(f"^{step.names}".encode()) % PATH_DIM) if step else _bits(1 << zlib.crc32(b"^") % PATH_DIM)
    raw = [t.encode("utf-8", "surrogatepass").lower() for t, _ in found]
    at = np.concatenate(([0], np.cumsum([len(b) for b in raw])))
    w = split_words(np.frombuffer(b"".join(raw), np.uint8), at)
    n = np.diff(w.offsets)
    cell = w.doc_of_word() * WORD_DIM + (w.hashes % np.uint64(WORD_DIM)).astype(np.int64)
    bag = np.bincount(cell, minlength=len(found) * WORD_DIM).reshape(-1, WORD_DIM)
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] = bag / np.sqrt(np.maximum(n, 1))[:, None]
    size = np.diff(at)
    last = np.array([b[-1] for b in raw])
    x[:, PATH_DIM + WORD_DIM :] = np.stack([np.log1p(size) / 8, np.log1p(n) / 6, np.isin(last, [33, 46, 63]), n == 1, np.linspace(0, 1, len(found)), np.full(len(found), np.log1p(len(found)) / 6)], 1)
    return x


@lru_cache(maxsize=50_000)
def _bits(places: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(places.to_bytes(PATH_DIM // 8, "little"), np.uint8), bitorder="little").astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """A bidirectional LSTM over block vectors, with a logistic output that also sees the block itself."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        scale = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"out": scale(2 * h + DIM), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": scale(DIM, 4 * h), f"U{d}": scale(h, 4 * h), f"c{d}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)}

    def _run(self, x: np.ndarray, live: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: pages, steps, DIM. Steps that aren't live carry the state on."""
        pages, steps, _ = x.shape
        h = c = np.zeros((pages, HIDDEN), np.float32)
        pre = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        out, tape = np.zeros((pages, steps, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.p[f"U{d}"]
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            on = live[:, t, None]
            c_new = f * c + i * g
            s = np.tanh(c_new)
            if keep:
                tape.append((t, h, c, i, f, o, g, s, on))
            h, c = np.where(on, o * s, h), np.where(on, c_new, c)
            out[:, t] = h
        return out, tape

    def _back(self, x: np.ndarray, d_out: np.ndarray, tape: list, d: str, grad: dict) -> None:
        dh = dc = np.zeros_like(d_out[:, 0])
        U = self.p[f"U{d}"]
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        gu = np.zeros_like(U)
        for t, h, c, i, f, o, g, s, on in reversed(tape):
            dh = dh + d_out[:, t]
            dhl, dcl = np.where(on, dh, 0), np.where(on, dc, 0)
            dcn = dcl + dhl * o * (1 - s * s)
            dz = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), dhl * s * o * (1 - o), dcn * i * (1 - g * g)], 1)
            dz_all[:, t] = dz
            gu += h.T @ dz
            dh = np.where(on, 0, dh) + dz @ U.T
            dc = np.where(on, dcn * f, dc)
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grad[f"W{d}"], grad[f"U{d}"], grad[f"c{d}"] = x.reshape(-1, DIM).T @ flat, gu, flat.sum(0)

    def scores(self, x: np.ndarray, live: np.ndarray, keep: bool = False):
        hf, tf = self._run(x, live, "f", keep)
        hb, tb = self._run(x, live, "b", keep)
        seen = np.concatenate([hf, hb, x], 2)
        return seen @ self.p["out"] + self.p["bias"], seen, tf, tb

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], seed: int = 6) -> Labeller:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(EPOCHS if pages else 0):
            order = rng.permutation(len(pages))
            for k in range(0, len(order), BATCH_PAGES):
                own = order[k : k + BATCH_PAGES]
                x, live = padded([pages[i] for i in own])
                x[:, :, :PATH_DIM] *= rng.random((*x.shape[:2], 1)) > HIDE * rng.random()
                y, _ = padded([labels[i][:, None] for i in own])
                z, seen, tf, tb = self.scores(x, live, True)
                dz = np.where(live, (_sigmoid(z) - y[:, :, 0]) / max(1, live.sum()), 0).astype(np.float32)
                grad = {"out": (seen * dz[:, :, None]).sum((0, 1)), "bias": dz.sum()[None]}
                d_seen = dz[:, :, None] * self.p["out"]
                self._back(x, d_seen[:, :, :HIDDEN], tf, "f", grad)
                self._back(x, d_seen[:, :, HIDDEN : 2 * HIDDEN], tb, "b", grad)
                step += 1
                for n, g in grad.items():
                    m[n] = 0.9 * m[n] + 0.1 * g
                    v[n] = 0.99 * v[n] + 0.01 * g * g
                    self.p[n] -= (RATE * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Main text or not, for each block of each page; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        while order:
            widest = len(pages[order[-1]])
            own = [order.pop() for _ in range(min(len(order), max(1, OPEN_BLOCKS // widest)))]
            x, live = padded([pages[i] for i in own])
            z = self.scores(x, live)[0]
            for i, row in zip(own, z, strict=True):
                out[i] = row[: len(pages[i])] > 0
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((len(pages), steps, pages[0].shape[1]), np.float32)
    live = np.zeros((len(pages), steps), bool)
    for i, p in enumerate(pages):
        x[i, : len(p)], live[i, : len(p)] = p, True
    return x, live


def trained(pages: DataFrame, sample: int = SAMPLE, sample_blocks: int = SAMPLE_BLOCKS) -> Labeller:
    """The labeller for a table of pages, the same whenever the table is.

    Pages are picked by page_id alone, cut and turned into vectors where they lie; at most
    ``sample_blocks`` vectors come to the driver.  A page with more than a tenth of these
    isn't learnt from.
    """
    order = lambda: [F.xxhash64("page_id"), "page_id"]
    ids = pages.where("html is not null").select("page_id").distinct().orderBy(*order()).limit(sample)
    rows = pages.where("html is not null").join(F.broadcast(ids), "page_id", "left_semi").select(F.col("page_id").cast("long"), F.xxhash64("html").alias("h"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = blocks(batch.column(2)[i].as_py())
                if 0 < len(found) <= sample_blocks // 10:
                    cells = [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([len(found)], pa.int32()), pa.array([vectors(found).astype(np.float16).tobytes()], pa.binary()), pa.array([labels(found).astype(np.uint8).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cells, ["page_id", "h", "n", "x", "y"])

    made = written(rows.mapInArrow(run, "page_id long, h long, n int, x binary, y binary"), "sample")
    # one row for each page of the sample: of repeated ids the least hash
    least = made.groupBy("page_id").agg(F.min(F.struct("h", "n")).alias("k")).select("page_id", "k.h", "k.n").orderBy(*order())
    chosen, total = [], 0
    for r in least.collect():
        total += r.n
        if total <= sample_blocks:
            chosen.append((r.page_id, r.h))
    if not chosen:
        return Labeller()
    keys = pages.sparkSession.createDataFrame(chosen, "page_id long, h long")
    got = {}
    for r in made.join(F.broadcast(keys), ["page_id", "h"], "left_semi").dropDuplicates(["page_id", "h"]).collect():
        got[r.page_id, r.h] = np.frombuffer(r.x, np.float16).reshape(-1, DIM).astype(np.float32), np.frombuffer(r.y, np.uint8).astype(np.float32)
    each = [got[k] for k in chosen]
    return Labeller().fit([x for x, _ in each], [y for _, y in each])


def main_text(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every page.

    A null or empty page, or one without main text, has the empty text.  Blocks are
    joined by one line feed, none is dropped or cut.  Repeated pages are labelled
    alike; an empty table gives an empty result; other columns are ignored.
    """
    labeller = labeller or trained(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = [blocks(x.as_py() or "") for x in part.column(2)]
                flat = vectors([b for f in found for b in f])
                cuts = np.cumsum([len(f) for f in found])[:-1]
                each = np.split(flat, cuts)
                for own in each:  # place and number of blocks are by page
                    if len(own):
                        own[:, -2], own[:, -1] = np.linspace(0, 1, len(own)), np.log1p(len(own)) / 6
                texts = ["\n".join(t for (t, _), good in zip(f, mark, strict=True) if good) for f, mark in zip(found, labeller.label(each), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
