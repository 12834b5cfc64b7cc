import random

import pytest
from pyspark.sql import functions as F

from lectern.operators.islands import islands, running_sum
from lectern.operators.segment import chunk_spans

P = "revision_id long, position int, section_path array<string>, block_kind string, text string"


def brute(rows):
    out, last = {}, {}
    for rev, pos, path, kind in sorted(rows, key=lambda r: (r[0], r[1])):
        if kind == "reference":
            continue
        p = last.get(rev)
        start = p[2] if p and p[0] == pos - 1 and p[1] == path else pos
        last[rev] = (pos, path, start)
        out[rev, pos] = start
    return out


@pytest.mark.parametrize("block", [3, 7, 4096])
def test_against_brute_force(spark, block):
    r = random.Random(block)
    rows = [(rev, p, r.choice([None, ["a"], ["a"], ["a", "b"], []]) if r.random() < 0.3 else ["x"], "reference" if r.random() < 0.05 else None) for rev in (1, 2) for p in range(60) if r.random() < 0.95]
    df = spark.createDataFrame([*rows, (None, 1, ["x"], None), (1, None, ["x"], None)], "revision_id long, position int, section_path array<string>, block_kind string")
    got = islands(df, "revision_id", "position", F.col("section_path"), ~F.coalesce(F.col("block_kind") == "reference", F.lit(False)), block)
    assert {(x["revision_id"], x["position"]): x["island"] for x in got.collect()} == brute(rows)
    sums = running_sum(df.where("revision_id is not null and position is not null"), ["revision_id"], "position", F.col("position"), block).collect()
    for x in sums:
        assert x["before"] == sum(p for rev, p, *_ in rows if rev == x["revision_id"] and p < x["position"])


def test_empty(spark):
    df = spark.createDataFrame([], P)
    assert islands(df, "revision_id", "position", F.col("section_path"), F.lit(True)).count() == 0
    assert chunk_spans(df).count() == 0


def by_definition(sizes, limit, shared):
    """Chunks of one section by trying every end and every start."""
    out, a, n = [], 0, len(sizes)
    while a is not None:
        z = max([a, *(k for k in range(a, n) if sum(sizes[a : k + 1]) <= limit)])
        starts = [k for k in range(a + 1, z + 1) if sum(sizes[k : z + 1]) <= shared]
        following = None if z == n - 1 else min([*starts, z + 1])
        out.append((a, z, following))
        a = following
    return out


@pytest.mark.parametrize("seed", range(3))
def test_chunks_against_the_definition(spark, seed):
    r = random.Random(seed)
    limit, shared = r.choice([(12, 5), (20, 19), (9, 0)])
    rows, want = [], set()
    for rev in range(12):
        sizes = [r.choice([0, 1, 2, 3, 7, 30]) for _ in range(r.randrange(1, 50))]
        if rev == 0:
            sizes = [r.randrange(4) for _ in range(600)]
        start = r.randrange(5)
        rows += [(rev, start + k, ["s"], None, "y" * size) for k, size in enumerate(sizes)]
        want |= {(rev, start + a, start + z, None if k is None else start + k) for a, z, k in by_definition(sizes, limit, shared)}
    rows.append((3, None, ["s"], None, "y"))
    got = [tuple(x) for x in chunk_spans(spark.createDataFrame(rows, P), limit, shared).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_sections_end_at_other_paths_gaps_and_bibliographies(spark):
    rows = [(7, 3, ["One"], None), (7, 4, ["One"], "equation"), (7, 5, ["One"], "reference"), (7, 6, ["One"], None), (7, 8, ["One"], None), (7, 9, ["Two"], None), (8, 9, ["Two"], None)]
    got = chunk_spans(spark.createDataFrame([(*x, "some words") for x in rows] + [(8, 10, ["Two"], None, None)], P))
    assert {tuple(x) for x in got.collect()} == {(7, 3, 4, None), (7, 6, 6, None), (7, 8, 8, None), (7, 9, 9, None), (8, 9, 10, None)}
