"""What a construct's own form says for and against markup: a logistic model of its shape, fitted on written examples.

``examples`` writes short texts of which it is known whether what looks like markup in them is any: every form of markup in
several settings, and the same signs in prose, program names, formulas, prices, running lines. They are made from patterns
and invented words, ``EXAMPLES`` of them from a fixed seed (a documented bound; the corpus has no part in it). The
constructs that the rules find in them are described by ``features``, and a ridge-penalised logistic regression gives the
log odds of markup. These are the terminal capacities of the minimum cut, so evidence from neighbours is weighed against
them on one scale.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from functools import lru_cache

import numpy as np

EXAMPLES, SEED, RIDGE = 6000, 20240311, 0.6
#: Features beside the one of each form; what a form does not have is zero.
SIGNS = ("known", "attributes", "unknown", "resolves", "braced", "formula", "letters", "fresh", "after_item", "stated", "closed", "long_line")
FORMULA_NAMES = frozenset("mathbb mathcal mathrm mathbf mathfrak mathsf frac dfrac tfrac sqrt sum prod int in le ge leq geq ne neq to mid bmod cdot ldots alpha beta gamma delta epsilon lambda mu pi sigma tau phi omega log exp min max Pr bar hat tilde overline left right quad".split())
_ITEM, _STATED = re.compile(r"[ \t]{0,3}[-+*][ \t]"), re.compile(r"\[\[|''|\d+[ \t]+[-–]")


def features(language: str, form: str, m: re.Match, text: str, elements: frozenset, commands: frozenset) -> dict[str, float]:
    """The signs of one construct; ``m`` is its match in ``text``."""
    out = {f"{language}.{form}": 1.0}
    a, z = m.span()
    if form == "tag":
        name = m.group(1).lower()
        out["known" if name in elements else "unknown"] = 1.0
        out["attributes"] = float(bool(m.group(2)) and name not in elements)
    elif form == "entity":
        out["resolves"] = 1.0 if html_lib.unescape(m.group()) != m.group() else -1.0
    elif form == "command":
        name = m.group(1)
        out["known" if name in commands else "unknown"] = 1.0
        out["braced"] = float(text[z : z + 1] == "{" and name not in commands)
        out["formula"] = float(name in FORMULA_NAMES and name not in commands)
    elif form in ("bullet", "quote", "row", "list"):
        line = text[text.rfind("\n", 0, max(0, a - 1)) + 1 : max(0, a - 1)]
        out["after_item"] = float(bool(_ITEM.match(line)) and form == "bullet")
        out["fresh"] = float(not line.strip())
        out["stated"] = float(form == "bullet" and _STATED.match(text, z) is not None)
    elif form in ("emphasis", "strong", "italic", "span", "bold"):
        out["letters"] = 1.0 if re.search(r"[^\W\d_]", m.group()) else -1.0
    elif form == "setext":
        out["long_line"] = float(len(m.group(2)) >= 3)
    elif form == "code":
        closed = language != "markdown" or m.group().rstrip(" \t").endswith("```")
        out["closed"] = 1.0 if closed else -1.0
    return out


def _words(r: random.Random, low: int = 1, high: int = 4) -> str:
    vowels, rest = "aeiou", "bcdfghklmnprstvz"
    return " ".join("".join(r.choice(rest) + r.choice(vowels) for _ in range(r.randrange(1, 4))) + r.choice(["", r.choice(rest)]) for _ in range(r.randrange(low, high + 1)))


def _markup(r: random.Random, language: str) -> str:
    w, u = _words(r), _words(r, 1, 1)
    n = r.randrange(2, 99)
    item = lambda mark: "\n\n" + "\n".join(f"{mark} {_words(r, 2, 6)}" for _ in range(r.randrange(2, 5)))
    if language == "html":
        tag = r.choice("b i em strong p div span td li h2 sup sub code a ul table tr br".split())
        return r.choice([f"<{tag}>{w}</{tag}>", f'<{tag} class="{u}">{w}</{tag}>', f"<{tag}/>", f"<!-- {w} -->", f"{w}&amp;{u}", f"{w}&#{n};", "&nbsp;", "&lt;", f'<a href="{u}">{w}</a>', f"<{tag}>", f"<pre>{w}</pre>", f"<table><tr><td>{w}</td><td>{u}</td></tr></table>"])
    if language == "markdown":
        rule = f"\n\n| {w} | {u} |\n|---|:--:|\n| {n} | {u} |\n| {u} | {w} |"
        return r.choice([f"**{w}**", f"__{w}__", f"*{w}*", f"_{w}_", f"\n\n{'#' * r.randrange(1, 5)} {w}\n\n", f"\n\n{w}\n{'=' * r.randrange(3, 9)}\n\n", f"\n\n{w}\n{'-' * r.randrange(3, 9)}\n\n", f"[{w}](https://{u}.org/{n})", f"![{w}]({u}.png)", f"`{u}_{n}`", f"\n\n> {w}\n\n", item("-"), item("*"), item("+"), rule, f"\n\n```\n{w} = {n}\n```\n"])
    if language == "wiki":
        return r.choice([f"'''{w}'''", f"''{w}''", f"\n\n{'=' * 2} {w} {'=' * 2}\n", f"\n\n=== {w} ===\n", f"[[{w}]]", f"[[{w}|{u}]]", "{{" + f"cite {u}|year={n}" + "}}", "\n\n{| class=plain\n! " + f"{w} !! {u}\n|-\n| {n} || {u}\n" + "|}\n", f"\n\n* [[{w}]]\n* ''{u}''"])
    name = r.choice("emph textbf textit texttt footnote section subsection caption title".split())
    bare = r.choice("maketitle noindent newline par centering".split())
    return r.choice([f"\\{name}{{{w}}}", f"\\cite{{{u}{n}}}", f"\\label{{{u}}}", f"\\ref{{{u}}}", f"\\{bare}", f"\n\\begin{{itemize}}\n\\item {w}\n\\item {u}\n\\end{{itemize}}\n", f"\\[ {u} \\ge {n} \\]", f"\\( {u} \\)", f"{{\\it {w}}}", f"\n\\begin{{{u}}}\n{w}\n\\end{{{u}}}\n", f"\\begin{{verbatim}}\n{w}\n\\end{{verbatim}}"])


def _alike(r: random.Random) -> str:
    """Signs of markup in what is none."""
    w, u, v = _words(r), _words(r, 1, 1), _words(r, 1, 1)
    n, k = r.randrange(2, 99), r.randrange(2, 99)
    name = r.choice(sorted(FORMULA_NAMES))
    return r.choice([
        f"{u[0]} < {v[0]} and {w} > {n}", f"<{u}> and <{v}>", f"{u.upper()[:1]}&{v.upper()[:1]}", f"&{u}; {w}", f"{n} * {k} * {n}", f"{n}*{k}*{n}", f"{u}_{v}_{n}", f"_{n}_", f"*{n}*", f"{u}''({v[0]})", f"{u} == {v}", f"#{n}", f"\\{name}", f"\\{name}{{{u[0]}}}", f"\\{u}",
        f"\n- {n} - {w}\n", f"\nwhere {w}\n- {u} {v}\n", f"\n* {n} {u} of\n", f"|{u}| + |{v}|", f"\n| {w} | {u} |\n", f"[{n}]", f"({u})[{n}]", f"${n} or ${k}", f"{u}**{n}", f"`` {w}", f"\n--\n{w}", f"''{n}''", f"\n```{u}",
    ])


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, str | None]]:
    """(text, the language of its markup or none)."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        language = ("html", "markdown", "wiki", "latex", None, None, None)[k % 7]
        inner = _alike(r) if language is None else _markup(r, language)
        if language is None and k % 5 == 0:  # a running line, at the start of a text or of a line of its own
            number = f"{r.choice('-*')} {r.randrange(2, 400)} -"
            out.append((r.choice(["", "\n\n"]) + number + r.choice(["", "  " + _words(r, 2, 4).capitalize(), "\n" + _words(r, 2, 9)]), None))
            continue
        before = _words(r, 3, 9).capitalize() + r.choice([" ", ". ", ", "])
        out.append((before + inner + r.choice([" ", ". "]) + _words(r, 2, 8) + ".", language))
    return out


class Model:
    """Log odds of markup of a construct."""

    def __init__(self, rows: list[dict[str, float]], y: np.ndarray):
        self.names = {f: i for i, f in enumerate(sorted({f for row in rows for f in row} | set(SIGNS)))}
        x = np.zeros((len(rows), len(self.names) + 1))
        x[:, -1] = 1
        for i, row in enumerate(rows):
            for f, v in row.items():
                x[i, self.names[f]] = v
        beta = np.zeros(x.shape[1])
        penalty = np.full(len(beta), RIDGE)
        penalty[-1] = 1e-6
        for _ in range(25):  # Newton's steps
            p = 1 / (1 + np.exp(-x @ beta))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
            beta += step
            if np.abs(step).max() < 1e-6:
                break
        self.weight, self.base = {f: float(beta[i]) for f, i in self.names.items()}, float(beta[-1])

    def log_odds(self, row: dict[str, float]) -> float:
        return self.base + sum(self.weight.get(f, 0.0) * v for f, v in row.items())


def found_in(n: int = EXAMPLES, seed: int = SEED) -> tuple[list[dict[str, float]], np.ndarray]:
    """Features and labels of the constructs in the examples; in a text with markup only those of its language count."""
    from lectern.llm.markup import COMMANDS, ELEMENTS, constructs

    rows, y = [], []
    for text, language in examples(n, seed):
        seen, found = constructs(text)
        for lang, form, m in found:
            if form == "command" and language and m.group(1) in FORMULA_NAMES:  # what a displayed formula holds
                continue
            if language is None or lang == language:
                rows.append(features(lang, form, m, seen if form != "code" else text, ELEMENTS, COMMANDS))
                y.append(language is not None)
    return rows, np.array(y, float)


@lru_cache(1)
def fitted() -> Model:
    return Model(*found_in())
