import sys

import pytest

from lectern.operators import ingest
from lectern.plans.session import Scripted, Tools, ask, server_sent, tool_schemas
from lectern.ports import SeededEmbedder
from lectern.sources.parsers import ParserFailed, ProgramParser, StubParser, failed_formulas, host_and_port, parse_files, run_to_json, store_output, stored_output


@pytest.fixture(scope="module")
def tables(spark):
    p = [(k, 1, k, k // 2, ["S"], f"paragraph {w}", "equation" if k == 2 else None, None) for k, w in enumerate("alpha beta gamma delta".split())] + [(9, 2, 0, 0, [], "paragraph old", None, None)]
    return {
        "paragraphs": spark.createDataFrame(p, "pid long, revision_id long, position int, page int, section_path array<string>, text string, block_kind string, block_label string"),
        "units": spark.createDataFrame([(5, 1, 0, 1, "Lemma 1", "lemma", "lemma", "g"), (6, 2, 0, 0, None, None, None, "g")], "unit_id long, revision_id long, first_pos int, last_pos int, anchor_label string, anchor_kind string, anchor_term string, gloss string"),
        "unit_questions": spark.createDataFrame([], "question_id long, unit_id long, question string"),
        "vectors": spark.createDataFrame([], "vector_id long, set_name string, target string, owner_id long, model string, emb array<float>"),
        "revisions": spark.createDataFrame([(1, "P", True, "ready"), (2, "P", False, "ready")], "revision_id long, paper_id string, is_current boolean, stage string"),
        "papers": spark.createDataFrame([("P", "Doc")], "paper_id string, name string"),
    }


def test_a_session_checks_what_it_cites(tables):
    e = SeededEmbedder(4)
    tools = Tools(tables, lambda q: e.queries([q], "ask")[0], cap=3)
    calls = [("search", {"q": "beta"}), ("get_unit", {"unit_id": 5}), ("get_unit", {"unit_id": 6}), ("get_paragraphs", {"document_id": "P", "first": 0, "last": 99}), ("get_document", {"document_id": "P"}), ("get_document", {"document_id": "Q"}), ("search", {"x": 1}), ("shout", {})]
    reply = {"answer": "so", "citations": [{"marker": "1", "paragraph_id": 1}, {"marker": "2", "paragraph_id": 3}, {"marker": "3", "paragraph_id": 9}]}
    log: list = []
    events = list(ask(Scripted(calls, reply), tools, "why", log.append))
    results = [x.data for x in events if x.kind == "tool_result"]
    assert [r["new_paragraphs"] for r in results] == [2, 0, 0, 1, 0, 0, 0, 0]
    assert [r["error"] is not None for r in results] == [False, False, True, False, False, True, True, True]
    final = events[-1].data
    assert [c["rendered"] for c in final["citations"]] == ["Doc, p. 1, S, Lemma 1", None, None] and final["answer"] == "so"
    assert log[0] | {"seconds": 0} == {"question": "why", "seconds": 0, "tool_calls": 8, "paragraphs_read": 3, "outcome": "answered", "citations": 3, "removed": 2}
    assert tools.get_document("P") == {"document": "Doc", "paragraphs": 4, "outline": [{"section": ["S"], "first_paragraph": 0, "page": 1}]}
    assert list(server_sent(iter(events[-1:])))[0].startswith("event: final\ndata: {") and set(tool_schemas()) == {"search", "get_unit", "get_paragraphs", "get_document"}


def test_outcomes_are_logged_whatever_happens(tables):
    log: list = []
    tools = Tools(tables, lambda q: [1.0])
    assert [e.kind for e in ask(Scripted([], None), tools, "a", log.append)] == []
    assert [e.kind for e in ask(Scripted([], None, "broken"), tools, "b", log.append)] == ["error"]
    left = ask(Scripted([("get_unit", {"unit_id": 5})], {"answer": "x", "citations": []}), tools, "c", log.append)
    next(left)
    left.close()
    assert [x["outcome"] for x in log] == ["no_answer", "error", "stopped"]


def test_programs_as_parsers(spark, tmp_path):
    good = [sys.executable, "-c", "import sys; sys.stdout.write(sys.stdin.read().upper())"]
    assert run_to_json(good, b'{"a": 1}', 20) == b'{"A": 1}'
    for command, says in (
        ([sys.executable, "-c", "import sys; sys.exit('one\\ntwo\\nthree\\nfour\\nfive\\nsix')"], "ended with 1: two\nthree\nfour\nfive\nsix"),
        ([sys.executable, "-c", "pass"], "wrote no result"),
        ([sys.executable, "-c", "import time; time.sleep(9)"], "more than 0.5 seconds"),
        (["/no/such/program"], "cannot be run"),
    ):
        with pytest.raises(ParserFailed, match=says.replace("(", r"\(")):
            run_to_json(command, b"", 0.5 if "more than" in says else 20)
    files = spark.createDataFrame([("s1", b"x"), ("s2", b"y")], "sha256 string, content binary")
    failing = parse_files(files, lambda: ProgramParser("p", "1", [sys.executable, "-c", "pass"], 20))
    assert {r["error"] is not None for r in failing.collect()} == {True}
    parsed = parse_files(files, StubParser)
    blocks = ingest.read_pages(parsed, "sha256", "raw")
    assert {(r["sha256"], r["text"]) for r in blocks.collect()} == {("s1", "Stub paragraph."), ("s2", "Stub paragraph.")}
    root = str(tmp_path / "store")
    assert stored_output(spark, root).count() == 0
    store_output(parsed, blocks.where("error IS NULL AND sha256 = 's1'"), root)
    store_output(parsed.where("sha256 = 's2'"), blocks.where("error IS NULL"), root)
    store_output(failing, blocks, root)
    assert {(r["sha256"], r["parser"], r["parser_version"]) for r in stored_output(spark, root).collect()} == {("s1", "stub", "0"), ("s2", "stub", "0")}


def test_addresses_and_formulas(spark):
    assert host_and_port("http://model:81/v1", 80) == ("model", 81) and host_and_port("model", 80) == ("model", 80)
    with pytest.raises(ValueError):
        host_and_port("", 80)
    from lectern.functions.latex import normalize

    f = spark.createDataFrame([("d", "x^2"), ("d", r"\frac{1}{")], "doc string, tex string")
    bad = failed_formulas(f, lambda: lambda tex: None if normalize(tex) else "not balanced")
    assert [tuple(r) for r in bad.collect()] == [("d", r"\frac{1}{", "not balanced")]
    files = spark.createDataFrame([("ab" * 32, "  "), ("cd" * 32, "A name"), ("cd" * 32, "A name")], "sha256 string, name string")
    papers, revisions = ingest.new_papers(files, "2024-01-01")
    assert {r["name"] for r in papers.collect()} == {"untitled", "A name"} and revisions.count() == 2
    assert papers.join(revisions, "paper_id").count() == 2
