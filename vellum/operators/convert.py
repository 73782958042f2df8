"""Text, Markdown and HTML to LaTeX bodies."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import sql_strip, strip
from vellum.sources import views as V

# Replacements in this order; the braces that the first one makes are escaped again by the later ones.
ESCAPES = [("\\", r"\textbackslash{}"), ("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}")]
# Elements left out, elements inside a line, and the commands of the heading levels.
HIDDEN = frozenset("script style nav header footer aside form iframe noscript svg".split())
INLINE = frozenset("strong b em i code a span sup sub mark u".split())
LEVELS = ("section", "subsection", "subsubsection", "paragraph", "subparagraph", "subparagraph")
# What inline elements turn into, a rule across the page, and where a document begins.
WRAPPED = {"strong": "textbf", "b": "textbf", "em": "textit", "i": "textit", "code": "texttt", "tt": "texttt", "kbd": "texttt", "sup": "textsuperscript", "sub": "textsubscript", "u": "underline", "mark": "underline"}
RULE = r"\noindent\rule{\linewidth}{0.4pt}"
PREAMBLE = "\n".join((r"\documentclass[11pt,a4paper]{article}", r"\usepackage{fontspec}", r"\usepackage[a4paper,margin=2.5cm]{geometry}", r"\usepackage{hyperref}", r"\usepackage{verbatim}", r"\setlength{\parskip}{0.5em}", r"\setlength{\parindent}{0pt}", ""))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Line ends as Python's splitlines sees them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def escaped(text: Column) -> Column:
    out = text
    for a, b in ESCAPES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape(text: str) -> str:
    for a, b in ESCAPES:
        text = text.replace(a, b)
    return text


def text_body(text: Column) -> Column:
    """Paragraphs, split at blank lines, escaped and joined by a blank line; line ends inside a paragraph become forced ones."""
    parts = F.filter(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), r"\n\s*\n"), lambda p: strip(p) != "")
    one = lambda p: F.array_join(F.transform(F.split(F.regexp_replace(p, f"({LINE_END})\\z", ""), LINE_END), escaped), " \\\\")
    return F.concat(F.regexp_replace(F.array_join(F.transform(parts, one), "\n\n"), r"\s+\z", ""), F.lit("\n"))


# ---- Markdown -------------------------------------------------------------------

# Lines and marks of the Markdown that is understood.
_FENCE, _HEADING, _HRULE = re.compile(r"```[\w+-]*\s*$"), re.compile(r"(#{1,6})\s+(.+?)\s*#*\s*$"), re.compile(r"[-*_]{3,}\s*$")
_ITEM = re.compile(r"\s*(?:(?P<ul>[-*+])|\d+[.)])\s+(?P<said>.+)$")
_SPANS = (
    (re.compile(r"\*\*([^*\n]+)\*\*|__([^_\n]+)__"), "textbf"),
    (re.compile(r"(?<!\*)\*(?!\*)([^*\n]+)(?<!\*)\*(?!\*)|(?<!_)_(?!_)([^_\n]+)(?<!_)_(?!_)"), "textit"),
)
_CODE, _LINK = re.compile(r"`([^`\n]+)`"), re.compile(r"\[([^\]]+)\]\(([^)]+)\)")


def _inline(text: str) -> str:
    """Code first, which nothing else touches; then emphasis and links of the escaped rest."""
    out, at = [], 0
    codes = []
    for m in _CODE.finditer(text):
        out += [text[at : m.start()], f"\0{len(codes)}\0"]
        codes.append(rf"\texttt{{{escape(m[1])}}}")
        at = m.end()
    line = escape("".join([*out, text[at:]]))
    for pattern, command in _SPANS:
        line = pattern.sub(lambda m, command=command: rf"\{command}{{{m[1] or m[2]}}}", line)
    line = _LINK.sub(lambda m: rf"\href{{{m[2]}}}{{{m[1]}}}", line)
    return re.sub(r"\0(\d+)\0", lambda m: codes[int(m[1])] if int(m[1]) < len(codes) else m[0], line)


def _kinds(md: str):
    """(kind, what it says) of each line: code, fence, blank, heading, rule, ul, ol or text."""
    code = False
    for line in md.splitlines():
        if _FENCE.match(line):
            code = not code
            yield "fence", code
        elif code:
            yield "code", line
        elif not line.strip():
            yield "blank", ""
        elif m := _HEADING.match(line):
            yield "heading", (len(m[1]), m[2].strip())
        elif _HRULE.match(line):
            yield "rule", ""
        elif m := _ITEM.match(line):
            yield "ul" if m["ul"] else "ol", m["said"].strip()
        else:
            yield "text", line.strip()
    if code:
        yield "fence", None


def markdown_body(md: str) -> str:
    """Headings, lists, rules, fenced code, links, code and emphasis; the lines of a paragraph are joined."""
    out: list[str] = []
    lists = {"ul": "itemize", "ol": "enumerate"}
    last = None
    for kind, group in groupby(_kinds(md), key=lambda x: x[0]):
        if last in lists:  # one kind of list goes over into the other without a blank line
            out += [rf"\end{{{lists[last]}}}"] + [""] * (kind not in lists)
        said = [x for _, x in group]
        if kind == "text":
            out += [_inline(" ".join(said)), ""]
        elif kind == "heading":
            for level, title in said:
                out += [rf"\{LEVELS[level - 1]}*{{{_inline(title)}}}", ""]
        elif kind == "rule":
            out += [RULE, ""] * len(said)
        elif kind == "code":
            out += said
        elif kind == "fence":
            for opens in said:
                out += [r"\begin{verbatim}"] if opens else [r"\end{verbatim}", ""]
        elif kind in lists:
            out += [rf"\begin{{{lists[kind]}}}", *(rf"  \item {_inline(x)}" for x in said)]
        last = kind
    if last in lists:
        out.append(rf"\end{{{lists[last]}}}")
    return "\n".join(out).rstrip() + "\n"


# ---- HTML -----------------------------------------------------------------------


class _Tree(HTMLParser):
    """Elements as (tag, attributes, children); an end tag closes the nearest open element of its name."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple] = [("", {}, [])]

    def handle_starttag(self, tag, attrs):
        node = (tag, {k: v or "" for k, v in reversed(attrs)}, [])
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append((tag, {k: v or "" for k, v in reversed(attrs)}, []))

    def handle_endtag(self, tag):
        k = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k][0] == tag), 0)
        if k:
            del self.open[k:]

    def handle_data(self, data):
        self.open[-1][2].append(data)


def _under(node: tuple, tags: tuple[str, ...]):
    """Elements of these names below a node, in page order."""
    todo = list(reversed(node[2]))
    while todo:
        x = todo.pop()
        if not isinstance(x, str):
            if x[0] in tags:
                yield x
            todo += reversed(x[2])


def _plain(node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += reversed(x[2])
    return "".join(out)


def _words(text: str) -> str:
    """A text inside a line; white space at its ends becomes one space."""
    words = " ".join(text.split())
    edge = lambda c: " " if c.isspace() else ""
    return edge(text[:1]) + escape(words) + edge(text[-1:]) if words else edge(text[:1])


def _wrapped(node, said: str) -> str:
    tag, attrs, _ = node
    if tag in WRAPPED:
        return rf"\{WRAPPED[tag]}{{{said}}}"
    href = attrs.get("href", "") if tag == "a" else ""
    return rf"\href{{{href}}}{{{said}}}" if href and not href.startswith("#") else said


def _span(node) -> str:
    """A node inside a line, however deep it is."""
    open_ = [(None, iter((node,)), [])]
    while True:
        owner, rest, said = open_[-1]
        x = next(rest, None)
        if x is None:
            open_.pop()
            text = "".join(said)
            if not open_:
                return text
            open_[-1][2].append(_wrapped(owner, text.strip()))
        elif isinstance(x, str):
            said.append(_words(x))
        elif x[0] == "br":
            said.append(r" \\ ")
        elif x[0] not in HIDDEN:
            open_.append((x, iter(x[2]), []))


def _own_lines(node) -> list[str] | None:
    """The lines of a node that is a block of its own, each followed by an empty one; None for one that only holds others."""
    tag, _, children = ("", {}, []) if isinstance(node, str) else node
    if isinstance(node, str):
        words = " ".join(node.split())
        return [escape(words), ""] if words else []
    if tag in HIDDEN or tag == "br":
        return []
    if re.fullmatch("h[1-6]", tag):
        return [rf"\{LEVELS[int(tag[1]) - 1]}*{{{_span(node).strip()}}}", ""]
    if tag == "p" or tag in INLINE:
        said = _span(node).strip()
        return [said, ""] if said else []
    if tag in ("ul", "ol"):
        kind = "itemize" if tag == "ul" else "enumerate"
        return [rf"\begin{{{kind}}}", *(rf"  \item {_span(x).strip()}" for x in children if not isinstance(x, str) and x[0] == "li"), rf"\end{{{kind}}}", ""]
    if tag == "pre":
        return [r"\begin{verbatim}", _plain(node).rstrip(), r"\end{verbatim}", ""]
    if tag == "hr":
        return [RULE, ""]
    if tag == "table":
        rows = [[_span(c).strip() for c in r[2] if not isinstance(c, str) and c[0] in ("td", "th")] for r in _under(node, ("tr",))]
        return [x for r in rows if r for x in (r" \quad | \quad ".join(r), "")]
    return None


def _lines(nodes: list) -> list[str]:
    """Nodes as lines, those inside them in turn, quotations between their marks."""
    out, todo = [], [(x, None) for x in reversed(nodes)]
    while todo:
        node, after = todo.pop()
        if after is not None:
            out += after
            continue
        own = _own_lines(node)
        if own is not None:
            out += own
            continue
        if node[0] == "blockquote":
            out.append(r"\begin{quote}")
            todo.append((None, [r"\end{quote}", ""]))
        todo += [(x, None) for x in reversed(node[2])]
    return out


def html_body(page: str) -> tuple[str, str]:
    """(title, body): the title or else the first main heading; hidden parts are left out, of blank lines one stays."""
    tree = _Tree()
    tree.feed(page)
    tree.close()
    root = tree.open[0]
    first = lambda *tags: next(_under(root, tags), None)
    title = _plain(first("title") or ("", {}, [])).strip() or " ".join(_plain(first("h1") or ("", {}, [])).split())
    lines = _lines((first("body") or root)[2])
    kept = [x for k, x in enumerate(lines) if x.strip() or not k or lines[k - 1].strip()]
    return title, "\n".join(kept).rstrip() + "\n"


# ---- documents ------------------------------------------------------------------


def document(title: Column, body: Column) -> Column:
    """A whole LaTeX document."""
    name = F.when(F.coalesce(title, F.lit("")) == "", "Document").otherwise(escaped(title))
    return F.concat(F.lit(PREAMBLE), F.lit("\\title{"), name, F.lit("}\n\\date{}\n\\begin{document}\n\\maketitle\n\n"), body, F.lit("\n\\end{document}\n"))


def converted(uploads: DataFrame) -> DataFrame:
    """``uploads`` (name, content binary, title) with ``tex``, by the extension of the name; null where it isn't known."""
    ext = F.lower(F.regexp_extract("name", r"\.([A-Za-z]+)$", 1))
    text = decoded(F.col("content"))
    rows = uploads.withColumn("__ext", ext).withColumn("__text", text)
    page = html_column(F.when(F.col("__ext").isin("html", "htm"), F.col("__text")))
    rows = rows.withColumn("__page", page)
    body = (
        F.when(F.col("__ext") == "txt", text_body(F.col("__text")))
        .when(F.col("__ext").isin("md", "markdown"), markdown_column(F.when(F.col("__ext").isin("md", "markdown"), F.col("__text"))))
        .when(F.col("__ext").isin("html", "htm"), F.col("__page.body"))
    )
    title = F.coalesce(F.nullif("title", F.lit("")), F.when(F.col("__ext").isin("html", "htm"), F.col("__page.title")))
    return rows.withColumn("tex", F.when(body.isNotNull(), document(title, body))).drop("__ext", "__text", "__page")


# Row by row, some hundred at once: Arrow would hold 10,000 texts and what they give in a worker.
@F.udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType())]), useArrow=False)
def html_column(page: str | None) -> tuple[str, str]:
    return tuple(html_body(page or ""))


@F.udf(T.StringType(), useArrow=False)
def markdown_column(text: str | None) -> str:
    return markdown_body(text or "")


def decoded(content: Column) -> Column:
    """UTF-8 where valid, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


QUERIES = {
    "text_to_latex": lambda spark, d: V.table(spark, d, "documents").select("doc_id", F.md5(text_body(F.col("text")).cast("binary")).alias("digest"), F.length(text_body(F.col("text"))).alias("n_chars")),
    "markdown_to_latex": lambda spark, d: V.table(spark, d, "documents").select("doc_id", F.length(markdown_column("text")).alias("n_chars")),
    "html_to_latex": lambda spark, d: V.table(spark, d, "pages").select("page_id", html_column("html").alias("h")).select("page_id", "h.title", F.length("h.body").alias("n_chars")),
    "decode_text": lambda spark, d: V.table(spark, d, "documents").select("doc_id", (decoded(F.encode("text", "ISO-8859-1")) == F.col("text")).alias("round_trip"), F.length(decoded(F.encode("text", "UTF-8"))).alias("n_chars")),
}


def _sql_escape(x: str) -> str:
    for a, b in ESCAPES:
        x = f"replace({x}, '{a}', '{b}')"
    return x


_LINES = "(?:" + LINE_END.replace("\x85", r"\x{85}").replace(" ", r"\x{2028}").replace(" ", r"\x{2029}") + ")"
_PARTS = rf"list_filter(regexp_split_to_array(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '\n\s*\n'), lambda p: {sql_strip('p')} <> '')"
_PARTS = rf"list_transform({_PARTS}, lambda p: array_to_string(list_transform(regexp_split_to_array(regexp_replace(p, '{_LINES}\z', ''), '{_LINES}'), lambda q: {_sql_escape('q')}), ' \\'))"
_BODY = rf"(regexp_replace(array_to_string({_PARTS}, chr(10) || chr(10)), '\s+\z', '') || chr(10))"
ORACLE_SQL = {"text_to_latex": f"select doc_id, md5({_BODY}) as digest, length({_BODY}) as n_chars from documents"}
