import os
import threading
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import neighbours
from lectern.llm.neighbours import Codes, nearest, rotation, unit

SCHEMA = "vector_id long, set_name string, target string, owner_id long, model string, emb array<float>"


def made(n=900, copies=40):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((n // 6, 64))
    x = np.repeat(base, 6, axis=0) + 0.5 * rng.standard_normal((n // 6 * 6, 64))
    rows = [(i, "a" if i % 3 else "b", "t", i, "m", [float(np.float32(v)) for v in x[i] * (1 + i % 4)]) for i in range(len(x))]
    rows += [(5000 + i, "a", "t", i, "m", rows[1][5]) for i in range(copies)]  # a hot group of copies
    rows += [(8000, "a", "t", 0, "m", None), (8001, "a", "t", 0, "m", [0.0] * 64), (8002, "a", "t", 0, "m", [1.0] * 5), (8003, "a", "t", 0, "m", [float("nan")] * 64), (8004, "c", "t", 0, "m", [1.0] * 64), (8005, None, "t", 0, "m", [1.0] * 64)]
    return rows


def brute(rows, k, least):
    out = {}
    ok = [r for r in rows if r[5] is not None and len(r[5]) == 64 and np.isfinite(r[5]).all() and any(r[5])]
    for g in {(r[1], r[2]) for r in ok}:
        own = [r for r in ok if (r[1], r[2]) == g]
        ids = np.array([r[0] for r in own])
        s = unit(np.array([r[5] for r in own], np.float32))
        s = (s @ s.T).round(12)
        for i in range(len(own)):
            order = [j for j in np.lexsort((ids, -s[i])) if j != i][:k]
            out[ids[i]] = [ids[j] for j in order if s[i, j] >= least]
    return out


@pytest.mark.parametrize("cell", [10_000, 120])
def test_lists_against_brute_force(spark, cell):
    rows = made()
    want = brute(rows, 5, 0.6)
    got: dict = {}
    for r in sorted(nearest(spark.createDataFrame(rows, SCHEMA), k=5, least=0.6, cell=cell).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["id"], []).append(r["other"])
    wanted = {(i, j) for i, x in want.items() for j in x}
    found = {(i, j) for i, x in got.items() for j in x}
    if cell == 10_000:  # one cell a group: exact, order included
        assert got == {i: x for i, x in want.items() if x}
    assert len(found & wanted) >= 0.97 * len(wanted)


def test_recall_of_stated_queries(spark):
    rows = made()
    want = brute(rows, 10, -1)
    got = nearest(spark.createDataFrame(rows, SCHEMA), k=10, margin=0.35, cell=120, queries=F.col("id") % 10 == 0).collect()
    found = {(r["id"], r["other"]) for r in got}
    wanted = {(i, j) for i, x in want.items() if i % 10 == 0 for j in x}
    assert {i for i, _ in found} == {i for i, _ in wanted}
    assert len(found & wanted) >= 0.9 * len(wanted)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = unit(rng.standard_normal((600, 64)))
    c = Codes(x, x.mean(0), rotation(64))
    est, err = c.bounds(c, np.arange(100))
    true = x[:100] @ x.T
    assert (np.abs(est - true) <= err).mean() > 0.995
    i, j = c.reach(c, np.arange(100), 0.3)
    a, b = np.nonzero(est + err >= 0.3)
    assert len(set(zip(a, b)) - set(zip(i, j))) <= 0.001 * len(a)


def test_empty(spark):
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("stated", [False, True])
def test_large_cells_are_divided_and_split(spark, monkeypatch, stated):
    rows = made(1800)
    df, want = spark.createDataFrame(rows, SCHEMA), brute(rows, 5, -1)
    monkeypatch.setattr(neighbours, "CENTRES", 4)  # too few for the groups, so that their cells grow large
    monkeypatch.setattr(neighbours, "PLACED", 100)
    monkeypatch.setattr(neighbours, "LARGE", 2)
    seen = []
    divide = neighbours.divided
    monkeypatch.setattr(neighbours, "divided", lambda *a: seen.append(divide(*a)) or seen[-1])
    queries = F.col("id") % 10 == 0 if stated else None
    wanted = {(i, j) for i, x in want.items() if not stated or i % 10 == 0 for j in x}
    for split in (30_000, 60):
        monkeypatch.setattr(neighbours, "SPLIT", split)
        got = {(r["id"], r["other"]) for r in nearest(df, k=5, margin=0.3, cell=60, queries=queries).collect()}
        assert len(got & wanted) >= 0.9 * len(wanted) and {i for i, _ in got} == {i for i, _ in wanted}
        seen.append(got)
    assert seen[1] == seen[3] and seen[0].select("cell", "sub").distinct().count() > 8  # parts change nothing


def test_exact_setting(spark):
    rows = made(600, 10)
    want = {(i, j) for i, x in brute(rows, 4, -1).items() for j in x}
    got = nearest(spark.createDataFrame(rows, SCHEMA), k=4, margin=neighbours.EXACT, probes=None, cell=50)
    assert {(r["id"], r["other"]) for r in got.collect()} == want


def test_comparisons_per_vector_do_not_grow(monkeypatch):
    """Cells per vector and vectors per cell, from the counts that decide them: both stay as the collection grows."""
    for n in (10**5, 10**6, 10**9):
        first = min(max(1, n // neighbours.CELL), neighbours.CENTRES)
        size = n / first
        if size > neighbours.LARGE * neighbours.CELL:
            size /= min(-(-size // neighbours.CELL), neighbours.CENTRES)
        assert size <= neighbours.LARGE * neighbours.CELL


@pytest.mark.parametrize("least", [None, 0.6])
def test_waves_change_nothing(spark, monkeypatch, least):
    df, got = spark.createDataFrame(made(), SCHEMA), []
    for wave in (1, 1000):
        monkeypatch.setattr(neighbours, "WAVE", wave)
        got.append({(r["id"], r["other"], r["similarity"], r["rank"]) for r in nearest(df, k=5, least=least, cell=60).collect()})
    assert got[0] == got[1] and len(got[0]) > 1000


@pytest.mark.parametrize("stated", [False, True])
def test_many_copies_are_dropped_by_a_join(spark, monkeypatch, stated):
    df, got = spark.createDataFrame(made(), SCHEMA), []
    for most in (10, 1000):
        monkeypatch.setattr(neighbours, "BROADCAST_ROWS", most)
        got.append({(r["id"], r["other"], r["rank"]) for r in nearest(df, k=5, least=0.6, cell=120, queries=F.col("id") % 10 == 0 if stated else None).collect()})
    assert got[0] == got[1] and got[0]


def test_disk_is_bounded_whatever_number_of_cells_is_searched(spark):
    """Files of shuffles and of the shared folder at their peak, where a vector is compared in dozens of cells."""
    n, blocks = 6000, spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    x = np.random.default_rng(3).standard_normal((n, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, "a", "t", i, "m", v.tolist()) for i, v in enumerate(x)], SCHEMA)
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    folders = [Path(f.getPath()) for f in blocks.localDirs()] + [shared]

    def used():
        total = 0
        for folder in folders:
            for at, _, files in os.walk(folder):
                for f in files:
                    try:
                        total += os.path.getsize(os.path.join(at, f))
                    except OSError:
                        pass
        return total

    before, peak, over = used(), [0], threading.Event()

    def watch():
        while not over.wait(0.01):
            peak[0] = max(peak[0], used() - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        nearest(df, least=0.5, cell=60, margin=0.3).collect()
        peak[0] = max(peak[0], used() - before)
    finally:
        over.set()
        watcher.join()
    assert peak[0] <= 4.5 * x.nbytes
