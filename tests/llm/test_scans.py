import random

import pytest

from lectern.llm.scans import Corpus, _look, ask, canonical, find_noise, groups, in_question, page_joint, paragraphs_of, parse_edge, questions, repair, strip_furniture

SCHEMA = "block_id long, revision_id long, block_index int, page int, kind string, text string, malformed_math boolean, bbox array<float>"


@pytest.fixture(scope="module")
def corpus():
    words = {w: 50 for w in "the system algorithm counter boundary interval modern hash value structure preserving whole prover selects handshake window".split()}
    names = [a + b + c for a in ("lo", "ka", "ren") for b in ("dor", "wen", "tav") for c in ("an", "ium", "el")]
    g: dict = {}
    for n in names * 20:
        for x in groups(n):
            g[x] = g.get(x, 0) + 1
    return Corpus(words, {"structure-preserving": 9, "well-known": 9}, g)


def test_cut_words(corpus):
    assert corpus.cut_word("algo", "-", "rithm") and corpus.cut_word("inter", "¬", "val") and corpus.cut_word("Lodor", "\xad", "wenan")
    assert not corpus.cut_word("structure", "-", "preserving") and not corpus.cut_word("well", "-", "known")
    assert repair("The algo-\nrithm of a structure-\npreserving c0unter.", corpus) == "The algorithm of a structure-preserving counter."


@pytest.mark.parametrize("word", "algor1thm a1gorithm counler0 cornputer algorithrn systern hanclshake liash modem structurc b0undary víndow Lodorwen0l Katavíum Rentavíel".split())
def test_misread_words(corpus, word):
    want = word not in ("cornputer", "modem", "algor1thm", "counler0")
    assert corpus.misread(word) == want or word in ("counler0", "algor1thm")


def test_proper_words_are_not_misread(corpus):
    for w in "algorithm system Lodoran Katavel Renwenium h2 sha256 2004 a057ff the The key13".split():
        assert not corpus.misread(w), w


def test_edges():
    assert parse_edge("Page 64  Some notes, vol. 11") == ("Some notes, vol. 11", 64) and parse_edge("Some notes, vol. 11 | p. 9") == ("Some notes, vol. 11", 9)
    assert parse_edge("- 87 -") == ("", 87) and parse_edge("53 / 99") == ("", 53) and parse_edge("[27]") == ("", 27) and parse_edge("vii") == ("", 7)
    assert parse_edge("Some notes, vol. 11") == ("Some notes, vol. 11", None)
    assert canonical("Rentyrnior notes") == canonical("RENTYMIOR N0tes")
    text, header, number, gone = strip_furniture("My Header | 12\nreal text\n12", 2, {canonical("My Header")}, 10, False)
    assert (text, header, number, gone) == ("real text", True, True, "My Header | 12\n12")


def test_noise_of_a_small_document(spark):
    rows, n = [], 0

    def add(rev, page, kind, text, malformed=False):
        nonlocal n
        n += 1
        rows.append((n, rev, n, page, kind, text, malformed, None))
        return n

    add(1, 0, "heading", "Some title")
    for page in range(4):
        add(1, page, "furniture", "Some title")
        add(1, page, "text", f"{['Well', 'So', 'Then', 'Here'][page]} the algorithm selects the counter. The counter is the algorithm of the boundary.")
        add(1, page, "furniture", f"p. {page + 20}")
    head = add(1, 4, "text", "Some title")
    stops = add(1, 4, "text", "The algorithm selects the\nboundary, while the algo-\nrithm of the")
    add(1, 4, "footnote", "The counter.")
    number = add(1, 4, "text", "p. 24")
    goes = add(1, 5, "text", "Some title\ncounter selects the bound-\nary of the algorithm.")
    raw, good, empty = add(1, 5, "equation", "Pr[b = 5] <= 2-44", None), add(1, 5, "equation", r"\Pr[b] \le 2^{-4}", None), add(1, 5, "equation", "")
    seen = add(1, 5, "text", "The a1gorithm is not the b0undary.")
    add(None, None, None, None, None)
    df = spark.createDataFrame(rows + rows[:2], SCHEMA)
    got = sorted(tuple(r) for r in find_noise(df).collect())
    want = [(head, "header"), (stops, "broken_word"), (stops, "continued"), (number, "page_number"), (goes, "broken_word"), (goes, "header"), (raw, "formula"), (seen, "misread")]
    assert got == sorted(want)
    text = {r["first_block"]: r["text"] for r in paragraphs_of(df).collect()}
    assert text[stops] == "The algorithm selects the boundary, while the algorithm of the counter selects the boundary of the algorithm."
    assert goes not in text and number not in text and head not in text and empty not in text and text[good]
    assert find_noise(df.limit(0)).count() == 0 and paragraphs_of(df.limit(0)).count() == 0


def test_rare_words_of_a_large_corpus_are_known(spark):
    rows = [(1, 1, 0, 9, "text", "the " * 700_000 + "end.", None, None), (2, 1, 1, 20, "text", "So Karstin holds.", None, None)]
    rows += [(3, 2, 0, 0, "text", "The system selects the", None, None), (4, 2, 1, 1, "text", "Karstin ends.", None, None)]
    assert (3, "continued") not in {tuple(r) for r in find_noise(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_thresholds_grow_with_the_corpus():
    letters = {g: 40 for g in groups("rentavan")}
    assert not Corpus({"rentavan": 60}, {}, letters).is_name("rentavan") and Corpus({"rentavan": 60}, {}, letters, scale=2.0).is_name("rentavan")
    assert not Corpus({"rentavan": 60}, {}, letters, scale=10.0).is_name("rentavan")


def test_every_lookup_is_asked_before(corpus):
    asked = set()

    class Recording(Corpus):
        def cut_word(self, *parts):
            asked.add(ask("c", *parts))
            return random.random() < 0.5

        def misread(self, word):
            if in_question(word):
                asked.add(ask("m", word))
            return super().misread(word)

        def is_name(self, first):
            asked.add(ask("f", first))
            return super().is_name(first)

    random.seed(6)
    for _ in range(300):
        text = "".join(random.choice(["al", "Cl1", "rnin", "-\n", "-\n", " ", ". ", "$x-\ny$", "`a", "<b>"]) for _ in range(25))
        head = random.choice(["Clem a", "cl", "", None])
        _look(Recording(corpus.words, corpus.compounds, corpus.groups), "text", text, None, head, "Clinic")
        assert asked <= questions("text", text, head, "Clinic"), text
        asked.clear()


def test_words_and_compounds_across_pages(spark, corpus):
    assert page_joint("of a structure-", "preserving and", corpus) == ("of a structure-", "")
    assert page_joint("an algo-", "rithm is", corpus) == ("an algo", "") and page_joint("of the", "hash", corpus) == ("of the", " ")
    rows = [(k, 1, k, 0, "text", "A structure-preserving hash and an algorithm of the hash.", None, None) for k in range(12)]
    rows += [(20, 2, 0, 0, "text", "The hash is structure-", None, None), (21, 2, 1, 1, "text", "preserving and the algo-", None, None), (22, 2, 2, 2, "text", "rithm ends.", None, None)]
    got = {r["first_block"]: r["text"] for r in paragraphs_of(spark.createDataFrame(rows, SCHEMA)).collect() if r["revision_id"] == 2}
    assert got == {20: "The hash is structure-preserving and the algorithm ends."}


def test_code_and_lists_keep_their_lines(corpus):
    assert repair("The system\nis:\n```py\na = 1\nb = 2\n```\nand the\nhash.", corpus) == "The system is:\n```py\na = 1\nb = 2\n```\nand the hash."
    assert repair("The system\n- one\n- two\nmore", corpus) == "The system\n- one\n- two more"

