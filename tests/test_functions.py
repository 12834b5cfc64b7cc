import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions.latex import formulas, html_to_text, latex_norm, markdown_math, normalize
from lectern.functions.text import canonical_hash, content_hash, cover_density, matches, trigrams, websearch, word_similarity, words
from lectern.ports import Canned, Recorded, SeededEmbedder, complete_missing, embed, request_hash, truncated


@pytest.mark.parametrize(
    "same",
    [
        [r"\mathcal{O}(n)", r"\mathcal O \left( n \right)", r"\mathcal{O} \! ( { n } )"],
        [r"a_{7} \quad b^{k}", "a_7b^k", "a_7 % note\n b^k"],
        [r"\sqrt[3]{y}+\dfrac{p}{q}", r"\sqrt[ 3 ] y + \dfrac p q"],
        [r"\begin{array} u \end{array}", r"\begin{array}u\end{array}"],
    ],
)
def test_layout_does_not_matter(same):
    assert len({normalize(x) for x in same}) == 1 and normalize(same[0])


def test_latex_edges():
    assert normalize(r"\eta m") != normalize(r"\etam") and normalize(r"\mathsf{F}_p") != normalize(r"\mathsf{F}_q")
    for broken in (r"\dfrac{p}{", "q}", r"\begin{cases} u", r"\begin{cases} u \end{array}", r"\end{array}", r"\binom n", "{" * 5000 + "}" * 5000):
        assert normalize(broken) is None
    assert normalize("") is None and normalize(r"\quad \, % only layout") is None
    assert formulas(r"Let $u_1$ be prime, so $$v \mid u$$ holds.", None) == ["u_1", r"v \mid u"]
    assert formulas("plain words", None) == [] and formulas(None, "equation") == [] and formulas(r"u \ne v", "equation") == [r"u \ne v"]
    assert latex_norm("plain words", None) is None and latex_norm(r"$\quad$", None) is None


@pytest.mark.parametrize(
    "text, want",
    [
        (r"pay \$7 and \$8", []),
        ("from $7 to $8 a piece", []),
        ("$7 + n$ pieces", [("7 + n", False)]),
        ("the name `$HOME` and ``a $b` $`` but $c$", [("c", False)]),
        ("an open ` tick, $c$", [("c", False)]),
        ("~~~\n$a$\n~~~\n$b$", [("b", False)]),
        ("```\n$a$ never closed", []),
        ("$ spaced $ and $$wide$$", [("spaced", False), ("wide", True)]),
        ("$a\n\nb$", []),
        ("$$\na\n\nb\n$$", [("a\n\nb", True)]),
        ('<a href="$1">$x$</a> $', [("x", False)]),
        ("$$$$ $  $", []),
        ("", []),
        (None, []),
    ],
)
def test_formulas_of_markdown(text, want):
    assert markdown_math(text) == want


def test_formulas_are_found_in_linear_time():
    import time

    def took(piece, n):
        start = time.process_time()
        markdown_math(piece * n)
        return time.process_time() - start

    for piece in ("$ ", "$$ ", "` $", "`` ` $", "<a $", "$5 or ", "\\", "```\n$"):
        assert took(piece, 40_000) < 0.5 + 4 * took(piece, 20_000), piece


def test_html_of_a_block():
    got = html_to_text('<div>Fee: $9 &lt; limit<!-- $0 --> <math>k_1</math>;<BR>see <math display="block"> m &amp; n </math></div>')
    assert got.text == "Fee: \\$9 < limit $k_1$;\nsee $$m & n$$" and got.math == [("k_1", False), ("m & n", True)] and got.level is None
    assert html_to_text("<h3>Part <b>two</b></h3>") == ("Part two", [], 3)
    assert html_to_text("an open <math>x").text == "an open x" and html_to_text(None).text == "" and html_to_text("a < b").text == "a < b"
    many = html_to_text("<math>" * 20_000)
    assert many.text == "" and many.math == []


def best_extent(a, b):
    wanted, seq = set(trigrams(a)), trigrams(b)
    found = [len(wanted & set(seq[i:j])) / len(wanted | set(seq[i:j])) for i in range(len(seq)) for j in range(i + 1, len(seq) + 1)]
    return max(found, default=0.0) if wanted else 0.0


def test_word_similarity_against_all_extents():
    assert word_similarity("word", "two words") == pytest.approx(0.8)
    r = random.Random(5)
    for _ in range(300):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(12))) for _ in range(2))
        assert word_similarity(a, b) == pytest.approx(best_extent(a, b)), (a, b)


def test_full_text(spark):
    texts = ["Zero knowledge lattice", "zero-knowledge LATTICE quorum", "public key", "knowledge zero", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("w", words(F.col("text")))
    ids = lambda q: sorted(r["i"] for r in df.where(matches(F.col("w"), websearch(q))).collect())
    assert ids('"zero knowledge"') == [0, 1] and ids("zero -quorum") == [0, 3] and ids('lattice or "public key"') == [0, 1, 2]
    assert ids("") == [] and not websearch(" ")
    assert cover_density("a x a".split(), websearch("a")) == pytest.approx(0.2)
    assert cover_density("a b".split(), websearch("a b")) > cover_density("a x x b".split(), websearch("a b")) > 0


def test_content_hash_collapses_every_blank(spark):
    df = spark.createDataFrame([("a  b\nc",), ("a b c",), (" a b\x1cc ",), ("a b d",), (None,)], "t string").select(content_hash(F.col("t")).alias("h"))
    h = [r["h"] for r in df.collect()]
    assert h[0] == h[1] == h[2] != h[3] and h[4] is None


def test_ports(spark):
    e = SeededEmbedder(8)
    assert np.allclose(e.queries(["q"], "ask"), e.documents(["ask\nq"]))
    assert np.allclose(np.linalg.norm(truncated(np.array([[3.0, 4.0, 9.0]]), 2)), 1)
    df = embed(spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "id long, t string"), "id", "t", e)
    got = {r["id"]: r["emb"] for r in df.collect()}
    assert set(got) == {1, 3} and got[1] == got[3]
    assert canonical_hash({"b": "é", "a": 1}) == canonical_hash({"a": 1, "b": "é"})
    r = Recorded(['{"request": {"m": 1, "cache_prefix": 3}, "completion": {"text": "yes"}}'])
    assert r.complete({"m": 1})["text"] == "yes" and request_hash({"m": 1}) == request_hash({"m": 1, "cache_prefix": 9})
    with pytest.raises(KeyError):
        r.complete({"m": 2})
    c = Canned([{"t": 1}])
    assert c.complete({"q": 1}) == {"t": 1} and c.asked == [{"q": 1}]
    req = spark.createDataFrame([("h1", '{"m": 1}'), ("h2", '{"m": 2}'), ("h3", '{"m": 1}'), ("h1", '{"m": 1}')], "input_hash string, request string")
    out = complete_missing(req, spark.createDataFrame([("h3",)], "input_hash string"), lambda: Recorded(['{"request": {"m": 1}, "completion": {"text": "yes"}}']))
    rows = {x["input_hash"]: x for x in out.collect()}
    assert set(rows) == {"h1", "h2"} and rows["h1"]["error"] is None and "KeyError" in rows["h2"]["error"]
