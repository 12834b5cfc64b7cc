import random
from datetime import datetime, timedelta

import pytest

from lectern.streaming.incremental import IncrementalRuns, Void, history

T0 = datetime(2024, 1, 1)
ROWS = "delivery_id long, revision_id long, position int, content_hash string, modified_at timestamp, arrived_at timestamp, client string"
RUNS = "run_id int, started_at timestamp, finished_at timestamp, status string"


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


def made(seed, n=300):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        key = (1, 0) if r.random() < 0.3 else (r.randrange(1, 4), r.randrange(5))
        h = None if r.random() < 0.2 else r.choice(["aa", " AA", "bb", "cc\n"])
        t = r.randrange(100)
        rows.append((i, *key, h, at(t), at(t + r.randrange(30)), "x"))
    rows += rows[:20] + [(900, None, 1, "aa", at(1), at(1), "x"), (901, 1, 1, "aa", None, at(1), "x"), (902, 1, 1, "aa", at(1), None, "x")]
    runs = [(k, at(10 * k + 5), None, r.choice(["succeeded", "succeeded", "failed", "crashed", "running"])) for k in range(1, 12)]
    return rows, runs


def brute(rows, runs):
    out, before = set(), {}
    for run, start, _, status in sorted((r for r in runs if r[1]), key=lambda x: x[1]):
        if status != "succeeded":
            continue
        now = {}
        for d, rev, pos, h, m, arrived, _ in rows:
            if rev is None or pos is None or arrived is None or arrived > start:
                continue
            v = (m is not None, m or T0, d, h.strip().lower() if h is not None else None)
            if (rev, pos) not in now or v[:3] > now[rev, pos][:3]:
                now[rev, pos] = v
        now = {k: v[3] for k, v in now.items()}
        out |= {(run, *k) for k, h in now.items() if h is not None and before.get(k) != h}
        before = now
    return out


def taken(job):
    got = [(r["run_id"], r["revision_id"], r["position"]) for r in job.sink().collect()]
    assert len(got) == len(set(got))
    return set(got)


def one(*rows):
    """Deliveries (id, position, hash, arrived) of revision 1, modified when they arrived."""
    return [(i, 1, p, h, at(t), at(t), "x") for i, p, h, t in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_history_against_brute_force(spark, seed):
    rows, runs = made(seed)
    runs += [(50, None, None, "succeeded"), (51, runs[-1][1], None, "succeeded")]
    got = [tuple(r) for r in history(spark.createDataFrame(rows, ROWS), spark.createDataFrame(runs, RUNS), 3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, runs)


def test_empty_tables(spark):
    rows, runs = spark.createDataFrame([], ROWS), spark.createDataFrame([], RUNS)
    assert history(rows, runs).count() == 0
    assert history(spark.createDataFrame(made(2)[0], ROWS), runs).count() == 0
    assert history(rows, spark.createDataFrame(made(2)[1], RUNS)).count() == 0


def test_runs_survive_failures_without_skipping_or_repeating(spark, tmp_path):
    rows, runs = made(3, 120)
    rows = [r for r in rows if r[1] is not None and r[4] is not None and r[5] is not None]
    runs = [(k, s, f, "succeeded") for k, s, f, _ in runs[:5]]
    fresh = lambda: IncrementalRuns(spark, str(tmp_path), partitions=3, compact_every=2)
    fails = {1: "commit", 2: "process", 3: "commit"}
    for k, start, _, _ in runs:
        new = [r for r in rows if r[5] <= start and (k == 1 or r[5] > runs[k - 2][1])]
        fresh().append(spark.createDataFrame(new, ROWS))
        if k in fails:
            with pytest.raises(RuntimeError):
                fresh().run(k, fail_at=fails[k])
        fresh().run(k)  # a new process
        fresh().run(k)  # a repeated call does nothing
    assert taken(fresh()) == brute(rows, runs)


def test_a_run_that_never_comes_back_leaves_its_records_to_the_next(spark, tmp_path):
    job = IncrementalRuns(spark, str(tmp_path), partitions=2)
    job.append(spark.createDataFrame(one((1, 1, "aa", 1)), ROWS))
    with pytest.raises(RuntimeError):
        job.run(1, fail_at="commit")
    job.run(2)
    assert [(r["run_id"], r["content_hash"]) for r in job.sink().collect()] == [(2, "aa")]


def test_late_deliveries_are_taken_once(spark, tmp_path):
    job = IncrementalRuns(spark, str(tmp_path), partitions=1)
    job.append(spark.createDataFrame(one((5, 1, "aa", 5)), ROWS))
    job.run(1)
    job.append(spark.createDataFrame(one((6, 2, "bb", 3), (4, 3, "cc", 5)), ROWS))  # they arrived before run 1 began
    with pytest.raises(RuntimeError):
        job.run(2, fail_at="commit")
    job.append(spark.createDataFrame(one((7, 4, "dd", 2)), ROWS))  # not in the plan that is replayed
    job.run(2)
    job.run(3)
    assert taken(job) == {(1, 1, 1), (2, 1, 2), (2, 1, 3), (3, 1, 4)}


def test_a_plan_is_void_once_a_later_run_has_committed(spark, tmp_path):
    job = IncrementalRuns(spark, str(tmp_path), partitions=2)
    job.append(spark.createDataFrame(one((1, 1, "aa", 1)), ROWS))
    with pytest.raises(RuntimeError):
        job.run(1, fail_at="process")
    old = job.folder.read("plans/000000000000.json")
    job.append(spark.createDataFrame(one((2, 2, "bb", 2)), ROWS))
    job.run(2)
    with pytest.raises(Void):
        job.process([old])
    job.append(spark.createDataFrame(one((3, 1, "cc", 3)), ROWS))
    job.run(1)
    assert taken(job) == {(2, 1, 1), (2, 1, 2), (1, 1, 1)}
    assert [c["commit"] for c in job.commits()] == [0, 1] and [c["run_id"] for c in job.commits()] == [2, 1]


def test_a_run_reads_its_own_appends_and_a_bounded_state(spark, tmp_path):
    job = IncrementalRuns(spark, str(tmp_path), partitions=2, compact_every=3)
    for k in range(9):
        job.append(spark.createDataFrame(one(*((10 * k + i, i, f"h{k}{i}", k) for i in range(4))), ROWS))
        plan = job.plan(k)
        assert plan["appends"] == [k]
        base, layers = job.sources()
        assert len(layers) < 3 and (base is not None) == (k >= 3)
        job.run(k)
    assert len(taken(job)) == 36 and job.state().count() == 4


def test_replay_can_die_and_be_repeated(spark, tmp_path):
    job = IncrementalRuns(spark, str(tmp_path), partitions=2)
    rows = one((1, 1, "aa", 1), (2, 2, "bb", 2), (3, 1, "cc", 3), (4, 2, "BB ", 4))
    from pyspark.sql import functions as F

    job.append(spark.createDataFrame(rows, ROWS), F.col("delivery_id") - 1)
    runs = [(10, 0, True), (11, 1, False), (12, 2, True), (13, 3, True)]
    with pytest.raises(RuntimeError):
        job.replay(runs, fail_at="commit")
    assert taken(job) == set()
    job.replay(runs)
    job.replay(runs)
    assert taken(job) == {(10, 1, 1), (12, 1, 1), (12, 1, 2)}
