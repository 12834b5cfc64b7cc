import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import ingest, lookup, reports, retrieval, segment
from lectern.plans.catalog import Conflict, ReadCatalog, WriteCatalog
from lectern.ports import SeededEmbedder
from lectern.streaming.outbox import collected

P = "pid long, revision_id long, position int, page int, section_path array<string>, text string, content_hash string, block_kind string, block_label string"
U = "unit_id long, revision_id long, first_pos int, last_pos int, anchor_label string, anchor_pos int, anchor_kind string, anchor_term string, gloss string"


@pytest.fixture(scope="module")
def corpus(spark):
    e = SeededEmbedder(64)
    texts = ["the only quorum", "plain", r"a formula $\alpha^2 + \beta$", "a reference to a lattice", "like the question"]
    kinds = [None, None, "equation", "reference", None]
    p = [(i, 1, i, i, ["S"], t, f"h{i}", k, None) for i, (t, k) in enumerate(zip(texts, kinds))] + [(9, 2, 0, 0, [], "the only quorum", "h9", None, None)]
    u = [(10, 1, 0, 1, "Lemma 1", 0, "lemma", "lemma", "g0"), (11, 1, 1, 2, None, None, None, None, "g1"), (12, 1, 4, 4, "Theorem 2", 4, "theorem", "theorem", "g2")]
    q = [(100, 10, "q0"), (101, 11, "ask\nfind"), (102, 12, "q2")]
    vec = [(i, "primary", "paragraph", x[0], "m", [float(y) for y in e.documents([x[5] if x[0] != 4 else "ask\nfind"])[0]]) for i, x in enumerate(p)]
    vec += [(50 + i, "primary", "gloss", x[0], "m", [float(y) for y in e.documents([x[8]])[0]]) for i, x in enumerate(u)]
    vec += [(80 + i, "primary", "question", x[0], "m", [float(y) for y in e.documents([x[2]])[0]]) for i, x in enumerate(q)]
    vec += [(95, "primary", "paragraph", 1, "m", None), (96, "primary", "paragraph", 1, "m", [float("nan")] * 64), (97, "primary", "paragraph", 1, "m", [0.0] * 64), (98, "primary", "paragraph", 1, "m", [1.0] * 3)]
    return {
        "paragraphs": spark.createDataFrame(p, P),
        "units": spark.createDataFrame(u, U),
        "unit_questions": spark.createDataFrame(q, "question_id long, unit_id long, question string"),
        "vectors": spark.createDataFrame(vec, "vector_id long, set_name string, target string, owner_id long, model string, emb array<float>"),
        "revisions": spark.createDataFrame([(1, "P", 1, True, "ready"), (2, "Q", 1, False, "ready")], "revision_id long, paper_id string, revision int, is_current boolean, stage string"),
        "papers": spark.createDataFrame([("P", "Doc"), ("Q", "Other")], "paper_id string, name string"),
    }


def ask(corpus, text="", **kw):
    query = SeededEmbedder(64).queries(["find"], "ask")[0]
    return [r.asDict() for r in retrieval.search(corpus, text, query, **kw).collect()]


def test_each_channel(corpus):
    assert ask(corpus, "quorum", channels=("fulltext",))[0] | {"score": 0} == {"item_type": "unit", "item_id": 10, "score": 0, "channels": {"fulltext": 1}, "matched_positions": [0]}
    assert {h["item_id"] for h in ask(corpus, r"\alpha^{2}+\beta", channels=("latex",))} == {11}
    best = ask(corpus, channels=("paragraph",))[0]
    assert best["item_id"] == 12 and best["matched_positions"] == [4] and best["score"] == round(1 / 61, 9)
    best = ask(corpus, channels=("question",))[0]
    assert best["item_id"] == 11 and best["matched_positions"] == []
    assert ask(corpus, "nowhere", channels=("fulltext",)) == [] and ask(corpus, "", channels=("fulltext", "latex")) == []


def test_scope_and_fusion(corpus):
    hits = ask(corpus, "quorum")
    assert [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)
    assert all(h["item_id"] != 9 for h in hits)
    assert not any(h["item_type"] == "paragraph" for h in ask(corpus, "lattice", channels=("fulltext",)))
    alone = ask(corpus, "lattice", channels=("fulltext",), exclude=())
    assert [(h["item_type"], h["item_id"], h["matched_positions"]) for h in alone] == [("paragraph", 3, [3])]
    assert {h["item_id"] for h in ask(corpus, "", kinds=("theorem",))} == {12}
    # a paragraph in two units credits both
    both = ask(corpus, "plain", channels=("fulltext",))
    assert {h["item_id"] for h in both} == {10, 11}
    full = retrieval.hydrate(retrieval.search(corpus, "quorum", SeededEmbedder(64).queries(["find"], "ask")[0]), corpus)
    assert {r["item_id"] for r in full.collect()} == {h["item_id"] for h in hits}


def test_empty_tables(spark, corpus):
    none = {k: v.limit(0) for k, v in corpus.items()}
    assert ask(none, "quorum") == []
    assert lookup.locations(none["paragraphs"], none["units"], none["revisions"], none["papers"]).count() == 0
    assert segment.uncovered(none["paragraphs"], none["units"]).count() == 0
    assert segment.quality_flags(none["units"], none["unit_questions"]).count() == 0


def test_tools(spark, corpus):
    loc = {r["pid"]: r["location"] for r in lookup.locations(corpus["paragraphs"], corpus["units"], corpus["revisions"], corpus["papers"]).collect()}
    assert loc[0] == "Doc, p. 1, S, Lemma 1" and loc[3] == "Doc, p. 4, S" and loc[9] == "Other, p. 1"
    cited = spark.createDataFrame([(1, 0), (2, 3), (3, 0), (4, 77)], "marker long, pid long")
    got = spark.createDataFrame([(0,), (3,), (77,)], "pid long")
    located = spark.createDataFrame(list(loc.items()), "pid long, location string")
    checked = lookup.check_citations(cited, got, located)
    assert {r["marker"]: r["removed"] for r in checked.collect()} == {1: None, 2: None, 3: None, 4: "no location"}
    places = {r["place"]: r["markers"] for r in lookup.citations_by_place(checked).collect()}
    assert places["Doc, p. 1, S, Lemma 1"] == [1, 3] and places["removed: no location"] == [4]
    assert lookup.paragraph_range(corpus["paragraphs"], 1, 0, 99, cap=3).count() == 3
    assert lookup.outline(corpus["paragraphs"]).count() == 2


def test_readers(spark):
    page = lambda *b: {"page_index": 0, "parsing_res_list": [{"block_label": x, "block_content": t, "block_bbox": [0, 0, 1, 1]} for x, t in b]}
    good = {"pages": [page(("text", "before"), ("doc_title", "Book"), ("paragraph_title", "One"), ("text", "in $x$"), ("doc_title", "Second"), ("text", "x"), ("display_formula", "$$y$$"), ("display_formula", "z = 1"))]}
    bad = {"pages": [page(("poem", "?"))]}
    docs = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad)), (3, "no json")], "id long, raw string")
    rows = ingest.read_pages(docs, "id", "raw").collect()
    one = sorted((r for r in rows if r["id"] == 1), key=lambda r: r["block_index"])
    assert [r["section_path"] for r in one] == [[], [], ["Book"], ["Book", "One"], [], ["Second"], ["Second"], ["Second"]]
    assert [r["malformed_math"] for r in one][-2:] == [False, True] and one[-2]["text"] == "y" and one[-2]["math"][0]["display"]
    assert {r["id"]: r["error"] for r in rows if r["error"]} == {2: "unknown label poem", 3: "not the schema"}
    tree = {"children": [{"children": [
        {"id": "h", "block_type": "SectionHeader", "html": "<h1>Title</h1>", "bbox": [0, 0, 1, 1], "section_hierarchy": {"1": "h"}},
        {"id": "g", "block_type": "ListGroup", "html": "", "children": [{"id": "t", "block_type": "Text", "html": "<p>a <math>b</math></p>", "bbox": [0, 0, 1, 1], "section_hierarchy": {"1": "h"}}]},
        {"id": "e", "block_type": "Equation", "html": '<math display="block">c</math>', "bbox": [0, 0, 1, 1]}]}]}
    rows = ingest.read_trees(spark.createDataFrame([(1, json.dumps(tree)), (2, "[")], "id long, raw string"), "id", "raw").collect()
    one = sorted((r for r in rows if r["id"] == 1), key=lambda r: r["block_index"])
    assert [(r["kind"], r["text"], r["section_path"], r["heading_level"]) for r in one] == [("heading", "Title", [], 1), ("text", "a $b$", ["Title"], None), ("equation", "c", [], None)]
    assert [r["error"] is not None for r in rows if r["id"] == 2] == [True]


def test_paragraphs_and_reconcile(spark):
    b = spark.createDataFrame([(1, i, 0, k, t, None, []) for i, (k, t) in enumerate([("heading", "T"), ("text", "a"), ("furniture", "1"), ("figure", "  "), ("equation", "x"), (None, "y")])], "revision_id long, block_index int, page int, kind string, text string, bbox array<float>, section_path array<string>")
    rows = sorted((r["position"], r["text"], r["block_kind"]) for r in ingest.paragraphs_from(b).collect())
    assert rows == [(0, "a", None), (1, "x", "equation"), (2, "y", None)]
    old = spark.createDataFrame([(1, 1, 0, "a", "A"), (2, 1, 1, "b", "B"), (3, 1, 2, "c", "C")], "pid long, revision_id long, position int, content_hash string, block_label string")
    new = spark.createDataFrame([(1, 0, "a"), (1, 1, "x"), (1, 5, "n")], "revision_id long, position int, content_hash string")
    got = {r["position"]: r for r in ingest.reconcile(old, new, ["block_label"]).collect()}
    assert {k: r["status"] for k, r in got.items()} == {0: "kept", 1: "changed", 2: "deleted", 5: "inserted"}
    assert got[0]["pid"] == 1 and got[0]["block_label"] == "A" and got[1]["pid"] != 2 and got[1]["block_label"] is None
    files = spark.createDataFrame([("x",), ("x",), ("y",)], "pdf_sha256 string")
    assert [r[0] for r in ingest.new_files(files, spark.createDataFrame([("y",)], "pdf_sha256 string")).collect()] == ["x"]


def test_shared_content(spark):
    long = ["w" * 100 + str(i) for i in range(4)]
    p = [(1, long[0], "h0"), (1, long[1], "h1"), (1, "short", "s"), (2, long[0], "h0"), (2, "short", "s"), (3, long[0], "h0")]
    got = ingest.shared_content(spark.createDataFrame(p, "revision_id long, text string, content_hash string"), spark.createDataFrame([(1, "A"), (2, "B"), (3, "A")], "revision_id long, paper_id string")).collect()
    assert {r["revision_id"]: (r["similar_paper_id"], r["similarity"]) for r in got} == {1: ("B", 0.5), 2: ("A", 1.0), 3: ("B", 1.0)}


def test_replies(spark):
    p = spark.createDataFrame([(1, 0, "Lemma 1 holds"), (1, 1, "so"), (1, 2, "x")], "revision_id long, position int, text string")
    rows = [(0, 0, 1, "Lemma 1", 0, "lemma", "LEMMA"), (1, 0, 1, "Lemma 1", 0, "lemma", "lemma"), (2, 1, 9, None, None, None, None), (3, 2, 2, "Lemma 1", None, None, None), (4, 1, 1, None, None, None, None), (5, 1, 2, "so", 0, "k", "so"), (6, 1, 2, "nope", 1, "k", "nope"), (7, 1, 2, "s", 1, "k", "lemma")]
    u = spark.createDataFrame([(1, 0, 2, *r) for r in rows], "revision_id long, chunk_first int, chunk_last int, ord int, first_pos int, last_pos int, anchor_label string, anchor_pos int, anchor_kind string, anchor_term string")
    got = {r["ord"]: r["error"] for r in segment.reply_errors(u, p).collect()}
    assert got == {1: "twice", 2: "outside the chunk", 3: "part of an anchor", 4: "out of order", 5: "anchor not in span", 6: "label not in paragraph", 7: "term not in label"}
    m = spark.createDataFrame([(1, 0, 2, 0, 0, 1, None), (1, 0, 2, 1, 1, 3, None), (1, 0, 2, 2, 2, 3, None), (1, 2, None, 0, 2, 3, None), (1, 2, None, 1, 4, 5, None)], "revision_id long, chunk_first int, keep_before int, ord int, first_pos int, last_pos int, anchor_label string")
    assert sorted((r["first_pos"], r["last_pos"], r["chunk_first"]) for r in segment.merge_replies(m).collect()) == [(0, 1, 0), (1, 3, 0), (2, 3, 2), (4, 5, 2)]


def test_flags_and_unit_changes(spark):
    u = spark.createDataFrame([(1, 1, 0, 0, None, "", ["x"]), (2, 1, 0, 0, "L", "g" * 601, ["Straße"]), (3, 1, 0, 0, "M", "what is a lattice", []), (4, 1, 0, 0, "N", None, [])], "unit_id long, revision_id long, first_pos int, last_pos int, anchor_label string, gloss string, terms array<string>")
    q = spark.createDataFrame([(2, "a"), (2, "b"), (2, "c"), (3, "What is a lattice?"), (3, None), (3, "z"), (3, "y")], "unit_id long, question string")
    p = spark.createDataFrame([(1, 0, "the straße")], "revision_id long, position int, text string")
    got = {r["unit_id"]: r["flags"] for r in segment.quality_flags(u, q, p, "terms").collect()}
    assert got == {1: ["gloss_empty", "term_absent", "question_count"], 2: ["gloss_long"], 3: ["question_restates_gloss"], 4: ["gloss_empty", "question_count"]}
    new = spark.createDataFrame([(1, 0, 0, None, ""), (1, 0, 0, "L", "new"), (1, 7, 8, None, "n")], "revision_id long, first_pos int, last_pos int, anchor_label string, gloss string")
    change = {(r["first_pos"], r["anchor_label"]): (r["change"], r["unit_id"]) for r in segment.unit_changes(u, new).collect()}
    assert change[0, None] == ("kept", 1) and change[0, "L"] == ("gloss_changed", 2) and change[0, "M"] == ("deleted", 3) and change[7, None][0] == "inserted"


def test_sample_does_not_depend_on_order(spark):
    df = spark.range(200).withColumn("stratum", F.col("id") % 3)
    a = {r["id"] for r in reports.stratified_sample(df, "stratum", "id").collect()}
    b = {r["id"] for r in reports.stratified_sample(df.orderBy(F.desc("id")).repartition(7), "stratum", "id").collect()}
    assert a == b and len(a) == 42


def test_reports_take_every_rater(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(1, "rater-00", 2), (1, "rater-01", 3), (1, "rater-07", 5), (2, "rater-07", 4), (2, "rater-11", 4), (3, "rater-05", None), (2, None, 1)]
    spark.createDataFrame(rows, "doc_id long, rater string, grade int").write.parquet(str(tmp_path / "reading_labels.parquet"))
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "doc_id long, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {n: {tuple(r) for r in entry.queries()[n](spark, str(tmp_path)).collect()} for n in ("final_scores_of_all_raters", "score_disagreements_of_all_raters", "scores_by_source_and_every_rater")}
    assert got["final_scores_of_all_raters"] == {(1, 5), (2, 4)}
    assert got["score_disagreements_of_all_raters"] == {(1, "rater-00", "rater-01", 2, 3), (1, "rater-00", "rater-07", 2, 5), (1, "rater-01", "rater-07", 3, 5)}
    assert {r for r in got["scores_by_source_and_every_rater"] if r[1] in ("rater-07", "rater-11")} == {("a", "rater-07", 5.0), ("b", "rater-07", 4.0), (None, "rater-07", 4.5), ("b", "rater-11", 4.0), (None, "rater-11", 4.0)}


def test_formulas_beside_escaped_dollars_are_counted(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(1, "text", r"it costs \$5, $x$ and $$y$$"), (1, "text", "so $z$"), (2, "equation", r"\$5 alone"), (3, "text", None)]
    spark.createDataFrame(rows, "revision_id long, block_kind string, text string").write.parquet(str(tmp_path / "paragraphs.parquet"))
    got = {tuple(r) for r in entry.queries()["formula_report"](spark, str(tmp_path)).collect()}
    assert {(1, 3, 0), (2, 0, 1)} <= got and {r[0] for r in got} == {1, 2, 3}


def test_gloss_reports(spark):
    rows = [("theorem", "faithful", "sensible", "readable")] * 9 + [("plain", "wrong", "too_broad", "readable"), ("plain", "unclear", None, "garbled"), ("game", "", "sensible", "readable"), ("game", None, None, None)]
    schema = "stratum string, verdict string, boundaries string, source string"
    got = reports.gloss_report(spark.createDataFrame(rows, schema)).first()
    assert (got["reviewed"], got["faithful"], got["wrong"], got["unclear"], got["overstated"]) == (11, 9, 1, 1, 0)
    assert (got["readable"], got["readable_faithful"], got["garbled"], got["wrong_formal"], got["bounded"], got["too_broad"], got["frozen"]) == (10, 9, 1, 0, 10, 1, True)
    more = spark.createDataFrame([*rows, *[rows[0]] * 9, ("definition", "wrong", None, "garbled")], schema)
    assert not reports.gloss_report(more).first()["frozen"] and not reports.gloss_report(more.limit(0)).first()["frozen"]
    assert {tuple(r) for r in reports.verdicts_by_stratum(more).collect()} == {("theorem", 18, 18, 0, 0, 0), ("plain", 2, 0, 0, 1, 1), ("definition", 1, 0, 0, 1, 0)}
    flags = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, [])], "unit_id long, flags array<string>")
    assert {tuple(r) for r in reports.flag_counts(flags).collect()} == {("a", 2), ("b", 1)}


def test_catalog(spark, tmp_path):
    w = WriteCatalog(spark, str(tmp_path))
    w.commit({"t": spark.range(3)}, meta={"k": "1"}, events=spark.createDataFrame([(1, "ready")], "id long, what string"))
    r = ReadCatalog(spark, str(tmp_path))
    other = WriteCatalog(spark, str(tmp_path))
    w.commit({"t": spark.range(5)}, events=spark.createDataFrame([(2, "changed")], "id long, what string"))
    assert r.table("t").count() == 3 and ReadCatalog(spark, str(tmp_path)).table("t").count() == 5
    with pytest.raises(Conflict):
        other.commit({"t": spark.range(9)})
    w.register_model("model", "a")
    w.register_model("model", "a")
    with pytest.raises(RuntimeError):
        w.register_model("model", "b")
    schema = spark.createDataFrame([], "id long, what string").schema
    args = (spark, str(tmp_path / "events"), schema, str(tmp_path / "cursor"), str(tmp_path / "read"))
    assert collected(*args).count() == 2 and collected(*args).count() == 2
    w.commit(events=spark.createDataFrame([(3, "ready")], "id long, what string"))
    assert sorted(x["id"] for x in collected(*args).collect()) == [1, 2, 3]
    assert not hasattr(r, "commit")


def test_nothing_outside_llm_imports_it():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "lectern"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "lectern.llm" not in f.read_text(), f


def test_many_questions_and_stored_indexes_change_nothing(spark, corpus, tmp_path):
    e = SeededEmbedder(64)
    texts = ["quorum", '"the only" -plain', "lattice or plain", "-quorum", r"\alpha^{2}+\beta", "", None]
    vectors = [[float(x) for x in e.queries([f"q{i}"], "ask")[0]] for i in range(5)] + [None, [0.0] * 64]
    asked = list(zip(range(len(texts)), texts, vectors))
    questions = spark.createDataFrame([*asked, asked[0]], "question long, text string, emb array<double>")
    index = retrieval.write_index(corpus["paragraphs"], str(tmp_path))
    for stored in ({}, index):
        got: dict = {}
        for r in retrieval.search_many(corpus | stored, questions, exclude=()).collect():
            got.setdefault(r["question"], set()).add((r["item_type"], r["item_id"], r["score"], tuple(sorted(r["channels"].items()))))
        for q, text, v in asked:
            alone = {(r["item_type"], r["item_id"], r["score"], tuple(sorted(r["channels"].items()))) for r in retrieval.search(corpus, text, v, exclude=()).collect()}
            assert got.get(q, set()) == alone, (q, bool(stored))
    retrieval_blocks = retrieval.AT_ONCE
    retrieval.AT_ONCE = 2
    try:
        again = {(r["question"], r["item_type"], r["item_id"], r["score"]) for r in retrieval.search_many(corpus, questions, exclude=()).collect()}
    finally:
        retrieval.AT_ONCE = retrieval_blocks
    assert again == {(q, t, i, s) for q, x in got.items() for t, i, s, _ in x}


def test_many_questions_take_one_pass(spark, corpus, tmp_path, monkeypatch):
    e = SeededEmbedder(64)
    texts = ["quorum", "formula or plain", "like the question", "-quorum", r"\alpha^{2}+\beta", "the", '"a formula" -plain']
    questions = spark.createDataFrame([(i, t, [float(x) for x in e.queries([f"q{i}"], "ask")[0]]) for i, t in enumerate(texts)], "question long, text string, emb array<double>")
    index = retrieval.write_index(corpus["paragraphs"], str(tmp_path / "whole"))
    passes = lambda q: retrieval.search_many(corpus | index, q)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    monkeypatch.setattr(retrieval, "AT_ONCE", 2)
    assert passes(questions) <= passes(questions.where("question = 3 OR question = 0"))
    # a word's places in a segment are one row
    same = spark.createDataFrame([(i, "one two one") for i in range(50)], "pid long, text string").coalesce(1)
    rows = retrieval.postings_of(same).collect()
    assert sorted(r["term"] for r in rows) == ["", "one", "two"]
    assert {r["term"]: (list(r["counts"][:2]), list(r["positions"][:4])) for r in rows if r["term"]} == {"one": ([2, 2], [0, 2, 0, 2]), "two": ([1, 1], [1, 1, 1, 1])}
    # segments, passes and lists of words of any size give the same
    hits = lambda t: sorted((r["question"], r["item_type"], r["item_id"], r["score"], r["place"], *sorted(r["channels"].items())) for r in retrieval.search_many(t, questions).collect())
    whole = hits(corpus | index)
    monkeypatch.setattr(retrieval, "SEGMENT", 10)
    monkeypatch.setattr(retrieval, "TOGETHER", 3)
    monkeypatch.setattr(retrieval, "LISTED", 0)
    assert whole and hits(corpus | retrieval.write_index(corpus["paragraphs"], str(tmp_path / "parts"))) == whole == hits(corpus)


def test_the_best_of_each_question_by_score_then_id():
    import numpy as np

    question, item, score = np.array([1, 1, 0, 1, 1, 0]), np.array([5, 4, 9, 5, 3, 9]), np.array([0.5, 0.9, 0.1, 0.95, 0.9, 0.2])
    assert list(zip(*(x.tolist() for x in retrieval._best(question, item, score, 2)))) == [(0, 9, 0.2, 0), (1, 5, 0.95, 0), (1, 3, 0.9, 1)]


def test_paper_filter_and_matched_positions(corpus):
    query = SeededEmbedder(64).queries(["find"], "ask")[0]
    assert ask(corpus, "quorum", papers=["Q"]) == [] and ask(corpus, "quorum", papers=["P"]) == ask(corpus, "quorum")
    full = {r["item_id"]: r for r in retrieval.hydrate(retrieval.search(corpus, "quorum", query, channels=("fulltext",)), corpus).collect()}
    assert [(p["position"], p["matched"]) for p in full[10]["paragraphs"]] == [(0, True), (1, False)]


def test_a_hash_that_many_papers_hold_is_spread(spark, monkeypatch):
    monkeypatch.setattr(ingest, "HELD", 3)
    rows = [(i, "w" * 100, "common") for i in range(20)] + [(i, "v" * 90 + str(i // 2), f"pair{i // 2}") for i in range(20)]
    p, r = spark.createDataFrame(rows, "revision_id long, text string, content_hash string"), spark.createDataFrame([(i, f"P{i:02d}") for i in range(20)], "revision_id long, paper_id string")
    got = {x["revision_id"]: (x["similar_paper_id"], x["similarity"]) for x in ingest.shared_content(p, r).collect()}
    assert got == {i: (f"P{i ^ 1:02d}", 1.0) for i in range(20)}
