import os
import random

import pytest

from lectern.llm.tokens import Encoded, Encoder, PrefixTable, Vocabulary, encode_corpus, vocabulary_path

LETTERS = "abcdefghij klmnop THE’é中\n\t  '0123456789<|>😀 ́\x1c"


@pytest.fixture(scope="module")
def encoder():
    with open(vocabulary_path(), "rb") as f:
        return Encoder(Vocabulary(f.read()), pieces=2000)


def texts(n=3000):
    r = random.Random(1)
    return ["".join(r.choice(LETTERS) for _ in range(r.randrange(60))) for _ in range(n)] + ["a" * 3000, " " * 100, "<|endoftext|>x", "the" * 500, "", "\n\n \n"]


def test_equal_to_the_public_library(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(os.path.dirname(vocabulary_path()), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text, want in zip(texts(), t.encode_batch(texts(), add_special_tokens=False)):
        assert list(encoder.encode(text)) == want.ids, text


def test_round_trip_append_and_edit(encoder):
    r = random.Random(2)
    for text in texts(300):
        assert b"".join(encoder.v.bytes[i] for i in encoder.encode(text)).decode() == text
    word = "pseudorandomness"
    table = PrefixTable(encoder.v)
    for i, c in enumerate(word):
        table.append(c.encode())
        assert table.tokens() == PrefixTable(encoder.v, word[: i + 1].encode()).tokens()
    for text in texts(500)[:500]:
        ids = [list(encoder.word(w)) for w in encoder.split(text)]
        a = r.randrange(len(text) + 1)
        z = r.randrange(a, len(text) + 1)
        changed, out = encoder.reencode(text, ids, a, z, "x y"[: r.randrange(4)])
        assert sum(out, []) == list(encoder.encode(changed))


def test_table(spark):
    rows = [(1, "a b", 5), (2, "", 5), (3, None, 5), (4, "x " * 50_000, 5), (1, "a b", 5)]
    got = encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids int")).collect()
    by = {r["doc_id"]: r["ids"] for r in got}
    assert len(got) == 5 and by[2] == by[3] == [] and len(by[1]) == 2 and len(by[4]) > 50_000
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_edits_cost_their_neighbourhood(encoder):
    r = random.Random(4)
    document = Encoded(encoder, " ".join(r.choice(["hash", "proof", "a  b", "x1", "\n", "don't"]) for _ in range(5000)))
    for k in range(40):
        if k % 4 == 0:
            n = document.append(r.choice([" more", "s", "  ", "", "'s"]))
        else:
            a = r.randrange(len(document.text))
            n = document.edit(a, min(len(document.text), a + r.randrange(6)), r.choice(["", " ", "x", "'re", " two words"]))
        assert n <= 12 and document.ids() == list(encoder.encode(document.text))
    empty = Encoded(encoder, "")
    empty.append("first")
    empty.append("")
    assert empty.ids() == list(encoder.encode("first"))
