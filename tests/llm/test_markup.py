import random
from itertools import product

import numpy as np
import pytest

from lectern.llm.markup import ANY, RULES, clean, clean_texts, find_markup, label, languages, languages_in_html, min_cut
from lectern.llm.markup_costs import examples, fitted, found_in


@pytest.mark.parametrize(
    "text, want",
    [
        ("Here a < b and c > d hold.", []), ("Both R&D groups agree.", []), ("The ratio is 2 * 3 * 4 rounds.", []), ("The field max_round_count is set.", []),
        ("It was attempt #4 of the run.", []), ("If p == q then stop.", []), ("As shown [12], it holds [3].", []), (r"where $x_{8} \in \mathbb{Z}_3$ and $a * b$.", []),
        (r"where \in \mathbb{Z}_{576}$. The", []), ("- 87 -  Some notes", []), ("It costs $5 or $6.", []),
        ("a <b>bold</b> word", ["html"]), ("extends&nbsp;it&#44; so", ["html"]), ("end.<!-- page 3 -->", ["html"]), ("<table><tr><td>a</td></tr></table>", ["html"]),
        ("a **bold** word", ["markdown"]), ("## Title\n\ntext", ["markdown"]), ("Title\n=====\n\n> quoted", ["markdown"]), ("see [this](https://a.b/c#d) now", ["markdown"]), ("text\n\n![plot](f.png)", ["markdown"]),
        ("the `x_6` span", ["markdown"]), ("text.\n\n- one\n- two", ["markdown"]), ("t\n\n| a | b |\n|---|:--:|\n| 1 | 2 |", ["markdown"]), ("t\n\n```python\n# not a heading\n```\n", ["markdown"]),
        ("a '''bold''' word", ["wiki"]), ("== Title ==\ntext", ["wiki"]), ("the [[Page|link]] here", ["wiki"]), ("t.{{cite note|year=2}}", ["wiki"]), ("t\n{| class=plain\n! a !! b\n|-\n| 1 || 2\n|}", ["wiki"]), ("=== H ===\n* [[A]]\n* ''b''", ["wiki"]),
        (r"an \emph{old} word", ["latex"]), (r"as~\cite{key10} says", ["latex"]), (r"so \[ n \ge 3 \]", ["latex"]), ("t\n\\begin{itemize}\n\\item a\n\\end{itemize}", ["latex"]), (r"{\it Title} text", ["latex"]),
        (r"a <i>b</i> and \textbf{c}", ["html", "latex"]), ("", []), (None, []), ("   ", []),
    ],
)
def test_languages(text, want):
    assert languages(text) == want


def test_clean_keeps_structure():
    assert clean("<h2>T</h2><p>a &amp; <b>b</b></p><ul><li>x</li></ul>") == "## T\n\na & b\n\n- x"
    assert clean("# T #\n\na **b** [c](d) `e`") == "# T\n\na b c e"
    assert clean("\\section{T}\\label{s}\nSee~\\cite{k} \\emph{x}\\footnote{n}. \\[ y \\]") == "# T\n\nSee x (n). $$y$$"
    assert "```\nround(k) -> k\n```" in clean("t\n\\begin{verbatim}\nround(k) -> k\n\\end{verbatim}")
    assert clean("{| class=x\n! a !! b\n|-\n| 1 || 2\n|}") == "a\tb\n1\t2"
    assert clean("plain $x^2$ text [1]") == "plain $x^2$ text [1]" and clean(None) is None and clean("") == ""
    long = "a < b. " * 50_000 + "<b>x</b>"
    assert clean(long).endswith("x") and len(clean(long)) == len(long) - 7


EXAMPLES = {
    ("html", "comment"): ["<!-- a -->"], ("html", "tag"): ["<b>", "</b>"], ("html", "entity"): ["&amp;", "&#44;"],
    ("markdown", "image"): ["![a](b)"], ("markdown", "link"): ["[a](b)"], ("markdown", "heading"): ["# T", "   ## T"], ("markdown", "setext"): ["T\n===", "T\n---", "T\n   ==="],
    ("markdown", "rule"): ["a | b\n--- | ---", "a | b\n:---: | :---", "|---|---|"], ("markdown", "row"): ["| a | b |"], ("markdown", "strong"): ["a **b** c", "a __b__ c"], ("markdown", "emphasis"): ["a *b* c", "a _b_ c"],
    ("markdown", "span"): ["`a`"], ("markdown", "quote"): ["> a", "  > a"], ("markdown", "bullet"): ["- a", "-\ta", " \t+ a"],
    ("wiki", "bold"): ["'''a'''"], ("wiki", "italic"): ["''a''"], ("wiki", "heading"): ["== T =="], ("wiki", "link"): ["[[a]]"], ("wiki", "template"): ["{{a}}"], ("wiki", "table"): ["{|\n|}"], ("wiki", "list"): ["* [[a]]", ": ''a''"],
    ("latex", "display"): [r"\[ a \]"], ("latex", "inline"): [r"\( a \)"], ("latex", "environment"): [r"\begin{a}"], ("latex", "command"): [r"\emph"],
}


@pytest.mark.parametrize("language, name, rule", RULES)
def test_cheap_test_lets_every_rule_through(language, name, rule):
    for text in EXAMPLES[language, name]:
        assert list(rule.finditer(text)) and ANY.search(text), text


@pytest.mark.parametrize("text", ["a __strong__ word", "an _old_ word", "Title\n---\n\ntext", "a | b\n--- | ---\n1 | 2", "t\n\n  > quoted", "t\n\n-\tone\n-\ttwo"])
def test_markup_without_another_trigger(text):
    assert languages(text) == ["markdown"] and clean(text) != text


def test_min_cut_is_the_cheapest_labelling():
    r = random.Random(1)
    for _ in range(200):
        n = r.randrange(1, 7)
        cost = [(r.random() * 3, r.random() * 3) for _ in range(n)]
        edges = [(i, j, r.random() * 2) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
        price = lambda lab: sum(c[0] if not x else c[1] for c, x in zip(cost, lab)) + sum(w for i, j, w in edges if lab[i] != lab[j])
        assert price(min_cut(cost, edges)) == pytest.approx(min(price(lab) for lab in product((False, True), repeat=n)))


def test_tables(spark):
    blocks = spark.createDataFrame([(1, "a <b>b</b>", "text"), (2, r"\alpha", "equation"), (3, "<b>", "code"), (4, None, "text"), (5, "x", None), (1, "a <b>b</b>", "text")], "block_id long, text string, kind string")
    paragraphs = spark.createDataFrame([(7, "a **b**", "<p>x **y** z</p>", None), (8, "p", None, "list_item"), (9, "**x**", "<p>x</p>", "code")], "pid long, text string, html string, block_kind string")
    got = sorted({tuple(r) for r in find_markup(blocks, paragraphs).collect()})
    assert got == [("blocks.text", 1, "html"), ("paragraphs.html", 7, "markdown"), ("paragraphs.text", 7, "markdown")]
    assert languages_in_html("<p>plain</p>") == []
    assert {(r["field"], r["row_id"]): r["text"] for r in clean_texts(blocks, paragraphs).collect()}["paragraphs.html", 7] == "x y z"
    assert find_markup(blocks.limit(0), paragraphs.limit(0)).count() == 0


@pytest.mark.parametrize("piece", [r"\emph{", "<!--", "{|\n", "'''a ", r"\[x ", r"\(x ", "- a\n", "<pre>", "<pre ", "# a   ", "== a", "**a ", "{{a", "```\n", "$a ", "<a b=\"", r"\begin{verbatim}", r"\begin{x}", "{\\bf ", "<b>", "`a", "# x" + " " * 50])
def test_unclosed_constructs_take_linear_time(piece):
    import time

    def took(n):
        start = time.process_time()
        clean(piece * n)
        languages_in_html(piece * n)
        return time.process_time() - start

    assert took(16_000) < 0.5 + 3 * took(8_000)


def test_code_is_part_of_the_cut():
    assert languages("```py\na < b\n```") == ["markdown"] and clean("<pre>a &lt; b</pre>") == "```\na < b\n```"
    assert clean("\\begin{verbatim}\n**a**\n\\end{verbatim}") == "```\n**a**\n```"
    nodes = label("Text **strong**\n```\n$x$ # not a heading\n```\n")
    assert [n.form for n in nodes] == ["strong", "code"]


def test_the_classifier_on_examples_it_has_not_seen():
    rows, y = found_in(2100, seed=77)
    odds = np.array([fitted().log_odds(r) for r in rows])
    p = odds > 0
    assert (p & (y > 0)).sum() >= 0.98 * p.sum() and (p & (y > 0)).sum() >= 0.97 * (y > 0).sum()
    near = (np.abs(odds) < 2) & ~np.isnan(odds)  # log odds mean what they say where they are not sure
    assert near.sum() == 0 or abs((1 / (1 + np.exp(-odds[near]))).mean() - y[near].mean()) < 0.25


def test_whole_texts_of_examples():
    got = [(set(languages(t)), {want} if want else set()) for t, want in examples(700, seed=5)]
    assert sum(a == b for a, b in got) >= 0.96 * len(got)


def test_tasks_take_the_model_they_are_given(spark):
    b = spark.createDataFrame([(1, "a **b** c", "text")], "block_id long, text string, kind string")
    p = spark.createDataFrame([(2, "a [[b]] c", None, None)], "pid long, text string, html string, block_kind string")
    assert {tuple(r) for r in find_markup(b, p).collect()} == {("blocks.text", 1, "markdown"), ("paragraphs.text", 2, "wiki")}
