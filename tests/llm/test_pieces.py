import random

import pytest

from lectern.llm import pieces
from lectern.llm.pieces import boundary, chunks, oversized, piece_count

SCHEMA = "pid long, revision_id long, position int, section_path array<string>, block_kind string, block_label string, text string"


def made(seed):
    r = random.Random(seed)
    rows, pid = [], 0
    for rev in (1, 2, 3):
        p = 0
        for s in range(4):
            for _ in range(r.choice([2, 8, 25])):
                n = r.choice([0, 5, 60, 300, 900 if r.random() < 0.2 else 40])
                word = lambda: "".join(r.choice("abcdé😀") for _ in range(r.randrange(1, 9)))
                t = " ".join(word() + r.choice(["", "", "", ".", ".\n"]) for _ in range(n // 5)) if r.random() < 0.9 else "x" * n
                rows.append((pid, rev, p, None if s == 1 else [f"S{s}"], "reference" if r.random() < 0.03 else None, "Lemma" if r.random() < 0.1 else None, None if r.random() < 0.03 else t))
                pid += 1
                p += 1 if r.random() < 0.97 else 2
    return rows


def sections(rows, limit):
    out, run = [], []
    for x in [*sorted(rows, key=lambda x: (x[1], x[2])), None]:
        if run and (x is None or x[1] != run[-1][1] or x[2] != run[-1][2] + 1 or x[3] != run[-1][3] or x[4] == "reference"):
            if sum(len(y[6] or "") for y in run) > limit:
                out.append(run)
            run = []
        if x is not None and x[4] != "reference":
            run.append(x)
    return out


@pytest.mark.parametrize("limit, overlap", [(400, 80), (1000, 0), (150, 40)])
def test_pieces_of_every_long_section(spark, limit, overlap):
    rows = made(limit)
    df = spark.createDataFrame([*rows, (9999, None, 1, None, None, None, "x"), (9998, 1, None, None, None, None, "x"), (10_000, *rows[0][1:6], "a repeated position")], SCHEMA)
    want = {(s[0][1], s[0][2]): s for s in sections(rows, limit)}
    assert {(r["revision_id"], r["first_pos"]): (r["last_pos"], r["chars"]) for r in oversized(df, limit).collect()} == {k: (s[-1][2], sum(len(y[6] or "") for y in s)) for k, s in want.items()}
    got: dict = {}
    for r in chunks(df, limit, overlap).collect():
        got.setdefault((r["revision_id"], r["first_pos"]), []).append(r)
    assert got.keys() == want.keys() and want
    for key, s in want.items():
        pieces = sorted(got[key], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces))) and len(pieces) >= piece_count(sum(len(x[6] or "") for x in s), limit, overlap)
        text = "".join(x[6] or "" for x in s)
        whole = ""
        for p in pieces:
            own = "".join(x["text"] for x in p["paragraphs"])
            assert len(own) == p["chars"] <= limit and 0 <= p["shared"] <= overlap
            assert whole.endswith(own[: p["shared"]])
            whole += own[p["shared"] :]
            by_pos = {x[2]: x[6] for x in s}
            for x in p["paragraphs"]:
                assert by_pos[x["position"]][x["start"] : x["start"] + len(x["text"])] == x["text"]
        assert whole == text
        assert pieces[-1]["keep_before"] is None and all(p["keep_before"] is not None for p in pieces[:-1])


def test_boundaries_by_strength():
    t = "One two. Three four\nfive six"
    assert boundary(t, -5, 5, 3, False) == (4, 0) and boundary(t, -5, 5, 3, True) == (5, 0)
    assert boundary(t, 2, 24, 10, False) == (3, 20) and boundary(t, 2, 12, 10, False) == (2, 9)
    assert boundary(t, 2, 6, 5, False) == (1, 4) and boundary("x" * 50, 10, 20, 15, False) == (0, 15)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chunks(df).count() == 0 and oversized(df).count() == 0
    with pytest.raises(ValueError):
        chunks(df, 10, 10)


def test_both_ways_of_finding_texts_agree(spark, monkeypatch):
    df = spark.createDataFrame(made(400), SCHEMA)
    got = []
    for bound in (500_000, 0):
        monkeypatch.setattr(pieces, "BROADCAST_POSITIONS", bound)
        monkeypatch.setattr(pieces, "BROADCAST_ROWS", bound)
        got.append({tuple(map(str, r)) for r in chunks(df, 400, 80).collect()})
    assert got[0] == got[1] and got[0]
