import json

import pytest
from pyspark.sql import functions as F

from lectern import ports
from lectern.functions.text import canonical_hash
from lectern.operators import glossing, reports

P = "revision_id long, position int, section_path array<string>, block_kind string, content_hash string, text string"
STORED = "revision_id long, input_hash string, gloss_model string, reply string"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, i, ["S"], k, f"h{i}", t) for i, (k, t) in enumerate([(None, "Lemma 4. Words hold"), ("equation", "e = f"), ("footnote", "see above"), (None, "Thus done")])]
    rows += [(2, 0, [], None, "g0", "another text"), (2, 1, [], "reference", "g1", "[1] A. Author"), (2, 2, [], None, "g2", None)]
    return spark.createDataFrame(rows, P), spark.createDataFrame([(1, "On words"), (2, None), (3, "empty")], "revision_id long, title string")


def unit(first, last, gloss="g", **more):
    return dict.fromkeys(("anchor_label", "anchor_pos", "anchor_kind", "anchor_term")) | {"first_pos": first, "last_pos": last, "gloss": gloss, "key_terms": [], "questions": ["q"]} | more


def test_requests_and_their_hashes(corpus):
    got = {(r["revision_id"], r["chunk_first"]): r for r in glossing.chunk_requests(*corpus, "v1", "m").collect()}
    assert set(got) == {(1, 0), (2, 0), (2, 2)}
    one = got[1, 0]
    want = {"title": "On words", "section": ["S"], "paragraphs": [[0, "h0", None], [1, "h1", "equation"], [2, "h2", "footnote"], [3, "h3", None]], "prompt": "v1", "model": "m"}
    assert one["input_hash"] == canonical_hash(want) and one["chunk_last"] == 3 and one["keep_before"] is None
    told = json.loads(one["request"])
    assert told["title"] == "On words" and told["section"] == ["S"] and told["paragraphs"][1] == {"pos": 1, "text": "e = f", "kind": "equation"} and "kind" not in told["paragraphs"][0]
    assert json.loads(got[2, 0]["request"])["title"] == ""


@pytest.mark.parametrize(
    "reply, error",
    [
        ([unit(0, 1), unit(3, 3)], None),
        ([unit(0, 1, anchor_label="Lemma 4", anchor_pos=0, anchor_kind="theorem", anchor_term="LEMMA"), unit(3, 3)], None),
        ([], "no units"),
        ([unit(0, 1)], "not covered"),
        ([unit(0, 4)], "outside the chunk"),
        ([unit(3, 3), unit(0, 1)], "out of order"),
        ([unit(0, 3), unit(0, 3)], "twice"),
        ([unit(0, 3, anchor_label="Lemma 4")], "part of an anchor"),
        ([unit(0, 3, anchor_label="Lemma 9", anchor_pos=0, anchor_kind="theorem", anchor_term="lemma")], "label not in paragraph"),
        ([unit(0, 3, anchor_label="Lemma 4", anchor_pos=0, anchor_kind="poem", anchor_term="lemma")], "schema"),
        ([{k: v for k, v in unit(0, 3).items() if k != "gloss"}], "schema"),
        ([unit(0, 3, extra=1)], "schema"),
        ([unit(0, None)], "schema"),
        ("no list", "schema"),
    ],
)
def test_rules_of_replies(spark, corpus, reply, error):
    rows = spark.createDataFrame([(1, 0, 3, None, json.dumps({"units": reply}))], "revision_id long, chunk_first int, chunk_last int, keep_before int, reply string")
    units, errors = glossing.first_errors(rows, corpus[0])
    assert [r["error"] for r in errors.collect()] == ([error] if error else [])
    if error is None:
        assert units.count() == 2


def test_replies_that_are_no_json(spark, corpus):
    rows = spark.createDataFrame([(1, 0, 3, None, r) for r in (None,)] + [(2, 0, 0, None, "{")] + [(3, 0, 0, None, '{"units": [], "more": 1}')], "revision_id long, chunk_first int, chunk_last int, keep_before int, reply string")
    assert {(r["revision_id"], r["error"]) for r in glossing.first_errors(rows, corpus[0])[1].collect()} == {(1, "schema"), (2, "schema"), (3, "schema")}


def test_a_run_asks_for_what_is_missing_only(spark, corpus):
    class Picky(ports.OnePerParagraph):  # local, so that tasks get it by value
        def complete(self, request):
            if request["title"] == "On words":
                raise ValueError("no")
            return ports.OnePerParagraph.complete(self, request)

    none = spark.createDataFrame([], STORED)
    first = glossing.gloss(*corpus, none, Picky, "v1", "m")
    assert first.calls == 3 and {r["error"] for r in first.errors.collect()} == {"ValueError: no"} and {r["revision_id"] for r in first.units.collect()} == {2}
    stored = spark.createDataFrame(first.replies.collect() + [(9, "gone", "m", "{}")], STORED)
    second = glossing.gloss(*corpus, stored, ports.OnePerParagraphInBatches, "v1", "m2")
    assert second.calls == 3  # another model, other hashes
    third = glossing.gloss(*corpus, spark.createDataFrame(second.replies.collect(), STORED), Picky, "v1", "m2")
    assert third.calls == 0 and third.errors.count() == 0
    got = {(r["revision_id"], r["first_pos"]): r for r in third.units.collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 2)} and got[1, 0]["gloss_model"] == "m2" and got[1, 0]["input_hash"] and got[1, 0]["prompt_version"] == "v1"
    assert "gloss_empty" in got[2, 2]["flags"] and got[2, 0]["flags"] == ["question_count"]
    live = glossing.chunk_requests(*corpus, "v1", "m")
    assert {r["input_hash"] for r in glossing.purged_replies(stored, live).collect()} == {r["input_hash"] for r in first.replies.collect()}
    more = spark.createDataFrame([(9, "gone", "m", "other"), (9, "new", "m", "x"), (9, "new", "m", "x")], STORED)
    assert {(r["input_hash"], r["reply"]) for r in glossing.kept_replies(stored.where("revision_id = 9"), more).collect()} == {("gone", "{}"), ("new", "x")}


def test_a_batch_that_fails_fails_whole(spark):
    class Broken:
        def complete(self, request):
            return {"n": request["n"]}

        def batch(self, requests):
            raise TimeoutError("late")

    req = spark.createDataFrame([(f"h{i}", json.dumps({"n": i})) for i in range(3)], "input_hash string, request string").coalesce(1)
    known = spark.createDataFrame([], "input_hash string")
    assert {r["error"] for r in ports.complete_missing(req, known, Broken).collect()} == {"TimeoutError: late"}
    assert [r["error"] for r in ports.complete_missing(req.limit(1), known, Broken).collect()] == [None]


def test_snapshots(spark):
    u = "unit_id long, revision_id long, first_pos int, last_pos int, anchor_label string, gloss string"
    old = spark.createDataFrame([(1, 1, 0, 1, None, "a"), (2, 1, 2, 2, "L", "b"), (3, 1, 5, 5, None, "c")], u)
    new = spark.createDataFrame([(0, 1, 0, 1, None, "a"), (0, 1, 2, 2, "L", "B"), (0, 1, 6, 6, None, "d")], u)
    units = glossing.next_units(old, new)
    got = {r["first_pos"]: (r["unit_id"], r["change"]) for r in units.collect()}
    assert got[0] == (1, "kept") and got[2] == (2, "gloss_changed") and got[6][1] == "inserted" and got[6][0] not in (1, 2, 3)
    assert [r["unit_id"] for r in glossing.unit_events(old, units).collect()] == [3]
    q = spark.createDataFrame([(10, 1, "x"), (11, 1, "y"), (12, 2, "z"), (13, 3, "w")], "question_id long, unit_id long, question string")
    told = units.withColumn("questions", F.when(F.col("unit_id") == 1, F.array(F.lit("x"), F.lit("y"))).when(F.col("unit_id") == 2, F.array(F.lit("z"), F.lit("more"))).otherwise(F.array().cast("array<string>")))
    questions = glossing.next_questions(q, told)
    rows = {(r["question"], r["kept"]) for r in questions.collect()}
    assert rows == {("x", True), ("y", True), ("z", False), ("more", False)}
    v = "vector_id long, set_name string, target string, owner_id long, model string, emb array<float>"
    vec = [(1, "primary", "paragraph", 7), (2, "primary", "gloss", 1), (3, "alt", "gloss", 2), (4, "alt", "question", 10), (5, "primary", "question", 12)]
    vectors = spark.createDataFrame([(*x, "m", [1.0, 2.0]) for x in vec] + [(6, "alt", "gloss", 1, "m", None)], v)
    assert {r["vector_id"] for r in glossing.next_vectors(vectors, units, questions).collect()} == {1, 2, 4, 6}
    made = spark.createDataFrame([(1, [3.0, 4.0]), (2, [5.0, 6.0]), (2, [5.0, 6.0])], "owner_id long, emb array<float>")
    filled = {(r["owner_id"], r["model"], r["emb"][0]) for r in glossing.filled_vectors(vectors, made, "alt", "gloss", "new").where("set_name = 'alt' AND target = 'gloss'").collect()}
    assert filled == {(2, "m", 1.0), (1, "new", 3.0)}
    none = spark.createDataFrame([], "revision_id long")
    paragraphs = spark.createDataFrame([(7, 1)], "pid long, revision_id long")
    assert glossing.cleared_vectors(vectors, none, paragraphs, units, questions).count() == 6
    left = glossing.cleared_vectors(vectors, spark.createDataFrame([(1,)], "revision_id long"), paragraphs, old, q)
    assert left.count() == 0 and {tuple(r) for r in glossing.vectors_left(vectors).where("target = 'gloss'").collect()} == {("primary", "gloss", 1), ("alt", "gloss", 1)}


def test_score_report_and_judged_sets(spark):
    s = spark.createDataFrame([("e", "a", 1), ("e", "a", 2), ("e", "b", 2), ("f", "a", 0), ("f", "b", 1), ("f", "b", 2)], "g string, p string, score int")
    f = spark.createDataFrame([("e", "a", 10, 1), ("f", "a", 30, 3), ("e", "b", 0, 0)], "g string, p string, formulas long, failed long")
    got = {(r["g"], r["p"]): tuple(r)[2:] for r in reports.score_report(s, f, "g", "p").collect()}
    assert got["e", "a"] == (1.5, 1, 10, 1, 0.1) and got["f", "b"] == (1.5, 1, None, None, None) and got["e", "b"][-1] is None
    assert got[None, "a"] == (1.0, 2, 40, 4, 0.1) and got[None, "b"] == (round(5 / 3, 6), 2, 0, 0, None)
    items = spark.createDataFrame([("e", None), ("f", "x"), ("f", "x")], "g string, k string")
    assert reports.chosen_items(items, items.where("k IS NULL"), ["g", "k"]).count() == 1
    assert reports.all_judged(items, s, ["g"]) and not reports.all_judged(items.withColumn("g", F.lit("z")), s, ["g"])
    assert reports.items_that_differ(items, s.where("g = 'f'"), ["g"]).count() == 2
    papers = spark.createDataFrame([("1", "b", None), ("2", "a", None), ("3", "c", 5)], "paper_id string, name string, created_at int")
    assert [r["paper_id"] for r in reports.newest_first(papers).orderBy("ord").collect()] == ["3", "2", "1"]
    blocks = spark.createDataFrame([(1, 0, 0, "furniture", "x"), (1, 1, 2, "text", "b"), (1, 1, 1, None, "a"), (1, None, 3, "text", "c")], "revision_id long, page int, block_index int, kind string, text string")
    assert {r["page"]: [b["text"] for b in r["blocks"]] for r in reports.page_items(blocks).collect()} == {0: [], 1: ["a", "b"]}
