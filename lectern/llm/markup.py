"""Markup residue in text: HTML, Markdown, wiki and LaTeX become clean text that keeps headings, lists, code and formulas.

Method: minimum-cut labelling. Every construct that could be markup (a tag, an emphasis mark, a command ...) is a node.
Its terminal capacity is the log odds of a fitted classifier (``markup_costs``) over the construct's own form (known name,
attributes, place in the line); constructs that lie close together and are of one language, and the two ends of a pair (the DOM's nesting),
are joined by smoothness edges. The maximum flow separates markup from content that only looks like it, such as
``a < b``, ``2 * 3``, ``R&D``, ``max_count`` or ``p == q``. What is labelled markup is converted, the rest stays as it is.

A region of code (a fence, ``verbatim``, ``pre``) is a node like any other; what lies inside it is not searched, nor are
formulas between dollar signs. Every rule looks at a character a bounded number of times, whatever is left unclosed:
constructs that run up to a closing sign are only tried where one follows.

Defined results: null, empty and blank texts have no markup and give themselves; unclosed constructs stay content unless
their neighbours say otherwise; very long texts are processed whole; the result of a text depends on nothing else.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.markup_costs import Model, features, fitted

# Names of HTML elements, those that break a line, and LaTeX commands that mark up text.
ELEMENTS = frozenset("a abbr address article aside b big blockquote body br button caption center cite code col dd del details div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd li link main mark math meta nav ol option p pre q s samp script section select small span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video".split())
BREAKING = frozenset("address article aside blockquote br center dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
COMMANDS = frozenset("emph textbf textit texttt textsc textrm textsf underline section subsection subsubsection chapter paragraph part label ref eqref cite citep citet footnote item caption title author begin end it bf tt em sc rm sf url href includegraphics input include centering noindent newline linebreak pagebreak par maketitle documentclass usepackage bibliography bibliographystyle vspace hspace index".split())
FORMULA = re.compile(r"(?<!\\)\$\$?[^$]+?(?<!\\)\$\$?")
PROSE = re.compile(r"[A-Za-z]{3,}(?:\s+[A-Za-z]{2,}){3}")
ANY = re.compile(r"<[a-zA-Z/!]|&#?\w+;|\*|`|^\s{0,3}#|\]\(|^ {0,3}>|^\s{0,3}[-+][ \t]|^[ \t]*:?-{3}|^ {0,3}={3}|(?<!\w)_|\[\[|\{\{|\{\||''|^=|\\[a-zA-Z\[(]|^[ \t]*\|", re.M)


class Delimited:
    """A lazily closed rule; ``finditer`` tries it only at openers that a closer follows, and jumps past what it found."""

    def __init__(self, rule: str, opener: str, closer: str, flags: int = re.S):
        self.rule, self.opener, self.closer = (re.compile(x, flags | re.M) for x in (rule, opener, closer))

    def finditer(self, text: str):
        openers = list(self.opener.finditer(text))
        if not openers:
            return
        closers, at, k = [m.start() for m in self.closer.finditer(text)], 0, 0
        for o in openers:
            if o.start() < at:
                continue
            while k < len(closers) and closers[k] < o.end():
                k += 1
            if k == len(closers):
                return
            m = self.rule.match(text, o.start())
            if m is not None:
                at = m.end()
                yield m

    def sub(self, new: str, text: str) -> str:
        parts, at = [], 0
        for m in self.finditer(text):
            parts += [text[at : m.start()], new]
            at = m.end()
        return "".join([*parts, text[at:]])


COMMENT, PRE = Delimited(r"<!--.*?-->", "<!--", "-->"), Delimited(r"<pre\b[^<>]*>(?:\s*<code\b[^<>]*>)?(.*?)(?:</code>\s*)?</pre>", r"<pre\b[^<>]*>", "</pre>", re.S | re.I)
RULES = [
    ("html", "comment", COMMENT),
    ("html", "tag", re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)((?:\s+[a-zA-Z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=]+))?)*)\s*/?>")),
    ("html", "entity", re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});")),
    ("markdown", "image", re.compile(r"!\[([^\]\n]*)\]\(([^()\s]+(?:\s+\"[^\"]*\")?)\)")),
    ("markdown", "link", re.compile(r"(?<!!)\[([^\[\]]+)\]\(([^()\s]+(?:\s+\"[^\"]*\")?)\)")),
    ("markdown", "heading", re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S[^\n]*)$", re.M)),
    ("markdown", "setext", re.compile(r"^(\S[^\n]*)\n {0,3}(={3,}|-{3,})[ \t]*$", re.M)),
    ("markdown", "rule", re.compile(r"^ {0,3}(?:\|?[ \t]*:?-{3,}:?[ \t]*)(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$", re.M)),
    ("markdown", "row", re.compile(r"^ {0,3}\|(?![-}+])[^\n]*\|[ \t]*$", re.M)),
    ("markdown", "strong", re.compile(r"\*\*(?=\S)([^*]+?)(?<=\S)\*\*|(?<!\w)__(?=\S)([^_]+?)(?<=\S)__(?!\w)")),
    ("markdown", "emphasis", re.compile(r"(?<![\w*])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w_\\{}^])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_{}^])")),
    ("markdown", "span", re.compile(r"(?<!`)`(?!`)([^`\n]+)`(?!`)")),
    ("markdown", "quote", re.compile(r"^ {0,3}>[ \t]?", re.M)),
    ("markdown", "bullet", re.compile(r"^[ \t]{0,3}[-+*][ \t]+(?=\S)", re.M)),
    ("wiki", "bold", Delimited(r"'''(?=\S)(.+?)(?<=\S)'''", r"'''\S", r"(?<=\S)'''")),
    ("wiki", "italic", re.compile(r"(?<!')''(?!')(?=\S)([^'\n]+?)(?<=\S)''(?!')")),
    ("wiki", "heading", re.compile(r"^(={2,6})(?=[ \t]*[^=\s])([^=\n]+)\1[ \t]*$", re.M)),
    ("wiki", "link", re.compile(r"\[\[([^\[\]|]+)(?:\|([^\[\]]*))?\]\]")),
    ("wiki", "template", re.compile(r"\{\{[^{}]*\}\}", re.S)),
    ("wiki", "table", Delimited(r"^\{\|.*?^\|\}", r"^\{\|", r"^\|\}")),
    ("wiki", "list", re.compile(r"^[*#:;]+[ \t]*(?=\[\[|'')", re.M)),
    ("latex", "display", Delimited(r"\\\[(.+?)\\\]", r"\\\[.", r"\\\]")),
    ("latex", "inline", Delimited(r"\\\((.+?)\\\)", r"\\\(.", r"\\\)")),
    ("latex", "environment", re.compile(r"\\(?:begin|end)\{[a-zA-Z*]+\}(?:\[[^\]\n]*\])?")),
    ("latex", "command", re.compile(r"\\([a-zA-Z]+)\*?")),
]
CODE = [
    ("markdown", re.compile(r"^ {0,3}```[^\n]*\n(.*?)(?:^ {0,3}```[ \t]*$|\Z)", re.M | re.S)),
    *(("latex", Delimited(rf"\\begin\{{{x}\}}\n?(.*?)\\end\{{{x}\}}", rf"\\begin\{{{x}\}}", rf"\\end\{{{x}\}}")) for x in ("verbatim", "lstlisting")),
    ("html", PRE),
]
NEAR, CLOSE, PAIR = 160, 0.6, 3.0


def min_cut(cost: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True: markup. cost[i] = (cost of calling i content, cost of calling it markup); edges cost when their ends differ."""
    n = len(cost)
    if not edges:
        return [a > b for a, b in cost]
    s, t = n, n + 1
    cap: list[dict[int, float]] = [{} for _ in range(n + 2)]

    def add(a, b, forth, back):
        cap[a][b] = cap[a].get(b, 0) + forth
        cap[b][a] = cap[b].get(a, 0) + back

    for i, (content, markup) in enumerate(cost):  # what both terminals give would flow through at once
        add(s, i, max(0.0, content - markup), 0)
        add(i, t, max(0.0, markup - content), 0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level, todo = {s: 0}, deque([s])
        while todo:
            u = todo.popleft()
            for v, c in cap[u].items():
                if c > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    todo.append(v)
        if t not in level:
            return [i in level for i in range(n)]
        turn = [iter(list(cap[u])) for u in range(n + 2)]
        path = [s]
        while path:  # blocking flow, without recursion
            u = path[-1]
            if u == t:
                least = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= least
                    cap[b][a] += least
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if cap[a][b] <= 1e-9)
                path = path[: cut + 1]
                continue
            for v in turn[u]:
                if cap[u][v] > 1e-9 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()


class Node:
    __slots__ = ("language", "form", "start", "end", "content", "markup", "match")

    def __init__(self, language, form, match, odds):
        """``content`` and ``markup`` are the costs of calling it so."""
        self.language, self.form, self.match = language, form, match
        self.start, self.end, self.content, self.markup = match.start(), match.end(), max(0.0, odds), max(0.0, -odds)


def masked(text: str) -> list[tuple[int, int]]:
    """Spans of formulas. A pair of dollar signs around plain prose is none."""
    out, at = [], 0
    while (m := FORMULA.search(text, at)) is not None:
        if PROSE.search(re.sub(r"\\[a-zA-Z]+", " . ", m.group())):
            at = m.start() + 1
        else:
            out.append(m.span())
            at = m.end()
    return out


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the spans (in order, apart) replaced by a character that no rule matches."""
    parts, at = [], 0
    for a, z in spans:
        parts += [text[at:a], "\x00" * (z - a)]
        at = z
    return "".join([*parts, text[at:]])


_given: list[Model] = []


def use(model: Model) -> None:
    """Label with a model that was fitted elsewhere."""
    _given[:] = [model]


def classifier() -> Model:
    """The model that tasks were given, or one fitted here."""
    return _given[-1] if _given else fitted()


def constructs(text: str) -> tuple[str, list[tuple[str, str, re.Match]]]:
    """(the text with code and formulas blanked, what could be markup as (language, form, match))."""
    out: list[tuple[str, str, re.Match]] = []
    seen = text
    for language, rule in CODE:
        found = list(rule.finditer(seen))
        out += [(language, "code", m) for m in found]
        seen = _blank(seen, [m.span() for m in found])
    seen = _blank(seen, masked(seen))
    taken = bytearray(len(seen))  # 1 where a construct that bars others lies
    for language, form, rule in RULES:
        for m in rule.finditer(seen):
            a, z = m.span()
            if form in ("bullet", "command", "row"):
                barred = bool(taken[a])
            else:
                barred = form not in ("quote", "list", "environment") and taken.find(1, a, z) >= 0
            if not barred:
                out.append((language, form, m))
                if form in ("comment", "tag", "template", "table", "rule", "setext", "list", "environment", "heading"):
                    taken[a:z] = b"\x01" * (z - a)
    return seen, out


def label(text: str) -> list[Node]:
    """The constructs that are markup, regions of code among them."""
    if not text or not ANY.search(text):
        return []
    seen, found = constructs(text)
    model = classifier()
    nodes = [Node(language, form, m, model.log_odds(features(language, form, m, text if form == "code" else seen, ELEMENTS, COMMANDS))) for language, form, m in found]
    if not nodes:
        return []
    nodes.sort(key=lambda n: (n.start, -n.end))
    edges = []
    for i, a in enumerate(nodes):
        for j in range(i + 1, min(i + 4, len(nodes))):
            b = nodes[j]
            if b.start - a.end > NEAR:
                break
            if a.language == b.language:
                edges.append((i, j, CLOSE))
    stack: list[tuple[str, int]] = []
    for i, n in enumerate(nodes):  # ends of one element or environment stand or fall together
        if n.form in ("tag", "environment"):
            closing = n.match.group().startswith(("</", "\\end"))
            name = n.match.group(1).lower() if n.form == "tag" else re.search(r"\{(.*?)\}", n.match.group()).group(1)
            if not closing:
                stack.append((name, i))
            else:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
                if k is not None:
                    edges.append((stack[k][1], i, PAIR))
                    del stack[k:]
    rules = [i for i, n in enumerate(nodes) if n.form == "rule"]
    for i, n in enumerate(nodes):
        if n.form == "row":
            edges += [(i, r, PAIR) for r in rules[:1]]
    chosen = min_cut([(n.content, n.markup) for n in nodes], edges)
    return [n for n, c in zip(nodes, chosen) if c]


def languages(text: str | None) -> list[str]:
    return sorted({n.language for n in label(text or "")})


def languages_in_html(text: str | None) -> list[str]:
    """Markup other than HTML in a text that is HTML anyway."""
    if not text or not ANY.search(text):
        return []
    plain = COMMENT.sub("", PRE.sub(" ", text))
    plain = RULES[1][2].sub(lambda m: "\n" if m.group(1).lower() in BREAKING else "", plain)
    return [x for x in languages(html_lib.unescape(plain)) if x != "html"]


def clean(text: str | None) -> str | None:
    """Text without markup. Headings become lines that begin with '# ' signs, list items lines with '- ', code is
    fenced, formulas stand between dollar signs."""
    if not text:
        return text
    nodes = label(text)
    if not nodes:
        return text
    parts, put = [], []
    closing = braces(text) if any(n.form == "command" for n in nodes) else {}
    for n in nodes:
        put += _replace(n, text, closing)
    at = 0
    for a, z, new in sorted(put, key=lambda p: (p[0], -p[1])):
        if a >= at:
            parts += [text[at:a], new]
            at = z
    out = "".join([*parts, text[at:]])
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<![ \t])[ \t]+\n", "\n", out)).strip()


def braces(text: str) -> dict[int, int]:
    """Where each brace that is closed is closed, in one pass."""
    out, stack = {}, []
    for m in re.finditer(r"[{}]", text):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out


def _replace(n: Node, text: str, closing: dict[int, int]) -> list[tuple[int, int, str]]:
    m, a, z, form = n.match, n.start, n.end, n.form
    g = lambda k: text[m.start(k) : m.end(k)]
    if form == "code":
        return [(a, z, "\n```\n" + html_lib.unescape(g(1)).strip("\n") + "\n```\n")]
    if form == "tag":
        name, closing = m.group(1).lower(), m.group().startswith("</")
        if re.fullmatch(r"h[1-6]", name):
            return [(a, z, "\n" if closing else "\n" + "#" * int(name[1]) + " ")]
        if name == "li":
            return [(a, z, "" if closing else "\n- ")]
        if name in ("td", "th"):
            return [(a, z, "\t" if closing else "")]
        return [(a, z, "\n" if name in BREAKING else "")]
    if form == "entity":
        return [(a, z, html_lib.unescape(m.group()).replace("\xa0", " "))]
    if form == "heading":
        inner = g(2).rstrip(" \t")
        inner = inner.rstrip("#").rstrip(" \t") if n.language == "markdown" else inner
        lead = len(inner) - len(inner.lstrip(" \t"))
        return [(a, m.start(2) + lead, "#" * len(m.group(1)) + " "), (m.start(2) + len(inner), z, "")]
    if form == "setext":
        return [(a, a, "# " if m.group(2)[0] == "=" else "## "), (m.end(1), z, "")]
    if form in ("strong", "emphasis", "span", "bold", "italic", "image"):
        k = 1 if m.group(1) is not None else 2
        return [(a, m.start(k), ""), (m.end(k), z, "")]
    if form == "link":
        k = 1 if n.language == "markdown" or m.group(2) is None else 2
        return [(a, m.start(k), ""), (m.end(k), z, "")]
    if form == "row":
        return [(a, z, g(0).strip().strip("|").strip().replace("|", "\t"))]
    if form == "table":
        rows = [re.sub(r"\s*(\|\||!!)\s*", "\t", x.lstrip("|!").strip()) for x in g(0).split("\n")[1:-1] if not x.startswith("|-")]
        return [(a, z, "\n".join(rows))]
    if form in ("bullet", "list"):
        return [(a, z, "- ")]
    if form in ("display", "inline"):
        sign = "$$" if form == "display" else "$"
        return [(a, z, sign + g(1).strip() + sign)]
    if form == "command":
        return _command(m, text, closing)
    return [(a, z, "\n" if form == "environment" else "")]


def _command(m: re.Match, text: str, closing: dict[int, int]) -> list[tuple[int, int, str]]:
    """A command with its braced argument: kept for commands that set text, dropped for those that name something."""
    name, a, z = m.group(1), m.start(), m.end()
    if name == "item":
        return [(a, z + (text[z : z + 1] == " "), "\n- ")]
    if text[z : z + 1] == "{":
        end = closing.get(z)
        if end is not None:
            if name in ("label", "cite", "citep", "citet", "ref", "eqref", "input", "include", "includegraphics", "bibliography", "bibliographystyle", "vspace", "hspace", "index", "usepackage", "documentclass"):
                return [(a - (text[a - 1 : a] == "~"), end + 1, "")]
            level = {"chapter": 1, "part": 1, "section": 1, "subsection": 2, "subsubsection": 3}.get(name)
            lead = "#" * level + " " if level else " (" if name == "footnote" else ""
            return [(a, z + 1, lead), (end, end + 1, "\n" if level else ")" if name == "footnote" else "")]
    if text[a - 1 : a] == "{" and name in ("it", "bf", "tt", "em", "sc", "rm", "sf"):
        end = closing.get(a - 1)
        if end is not None:
            return [(a - 1, z + (text[z : z + 1] == " "), ""), (end, end + 1, "")]
    return [(a, z, "")]


FIELDS = [("blocks.text", "block_id", "text", "kind"), ("paragraphs.text", "pid", "text", "block_kind"), ("paragraphs.html", "pid", "html", "block_kind")]


def _rows(blocks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    out = None
    for field, key, column, kind in FIELDS:
        df = blocks if field.startswith("blocks") else paragraphs
        prose = ~F.coalesce(F.col(kind).isin("code", "equation"), F.lit(False))
        part = df.where(prose & F.col(column).isNotNull()).select(F.lit(field).alias("field"), F.col(key).cast("long").alias("row_id"), F.col(column).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def find_markup(blocks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(field, row_id, markup): each language of markup in each text."""
    model = fitted()

    def run(batches):
        use(model)
        for b in batches:
            f, r, m = [], [], []
            for field, row, text in zip(*(c.to_pylist() for c in b.columns)):
                for x in languages_in_html(text) if field.endswith("html") else languages(text):
                    f.append(field)
                    r.append(row)
                    m.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(r, pa.int64()), pa.array(m, pa.string())], names=["field", "row_id", "markup"])

    return _rows(blocks, paragraphs).mapInArrow(run, "field string, row_id long, markup string")


def clean_texts(blocks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(field, row_id, text): every prose text cleaned."""
    model = fitted()

    def run(batches):
        use(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([clean(t) for t in b.column(2).to_pylist()], pa.string())], names=["field", "row_id", "text"])

    return _rows(blocks, paragraphs).mapInArrow(run, "field string, row_id long, text string")
