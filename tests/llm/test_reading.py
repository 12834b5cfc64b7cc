import random

import numpy as np
from pyspark.sql import functions as F

from lectern.llm.reading import MEASURES, Boosted, Levels, Measurer, isotonic, reading_levels

EASY = "cat dog hat box map pen cup list ring book door tree".split()
HARD = "orthogonality homomorphism pseudorandomness bootstrapping discretisation malleability quantification".split()


def text(r, grade):
    out = []
    for _ in range(r.randrange(4, 12)):
        n = 3 + 3 * grade + r.randrange(3)
        out.append(" ".join(r.choice(HARD if r.random() < (grade - 1) / 5 else EASY) for _ in range(n)).capitalize() + ".")
    return " ".join(out)


def made(n=400, seed=1):
    r = random.Random(seed)
    grades = [r.randrange(1, 6) for _ in range(n)]
    return [(i, text(r, g), "en", f"s{i % 7}") for i, g in enumerate(grades)], grades


def test_held_out_accuracy_by_source():
    rows, grades = made()
    m = Levels().fit([x[1] for x in rows], np.array(grades, float), [x[3] for x in rows])
    out, y, folds = m.left_out
    for k in set(folds):  # no source is in two folds
        assert not {rows[i][3] for i in np.flatnonzero(folds == k)} & {rows[i][3] for i in np.flatnonzero(folds != k)}
    cross = m.left_out_calibrated  # neither model nor curve has seen the source
    assert np.sqrt(np.mean((cross - y) ** 2)) < 0.7
    assert np.mean((cross >= 3.5) == (y >= 3.5)) > 0.9
    assert not np.allclose(cross, m.calibrated(out))


def test_trees_fit_and_isotonic_rises():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(500, 3))
    y = np.where(x[:, 0] > 0.5, 3.0, 1.0) + x[:, 1]
    assert np.mean((Boosted().fit(x, y).predict(x) - y) ** 2) < 0.02
    a, b = isotonic(np.array([1, 2, 3, 4.0]), np.array([1, 3, 2, 4.0]))
    assert list(b) == [1, 2.5, 4]


def test_measures_of_a_small_text():
    m = Measurer().measure(["The cat sat. The cat, it ran.", "", "...", "words " * 3000])
    by = dict(zip(MEASURES, m[0]))
    assert by["words"] == np.log1p(7) and by["sentence"] == 3.5 and by["distinct"] == 5 / 7 and by["referring"] == 1 / 7
    assert np.isnan(m[1]).all() and np.isnan(m[2]).all() and not np.isnan(m[3]).any()
    # a text's measures do not depend on its neighbours
    assert np.allclose(Measurer().measure(["The cat sat. The cat, it ran."]), m[:1])


def test_table(spark):
    rows, grades = made(120)
    docs = spark.createDataFrame([*rows, (900, None, "en", "s"), (901, "", "en", "s"), (902, " ?! ", "en", None), rows[0]], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, "r", g) for i, g in enumerate(grades)] + [(1, "q", None), (777, "r", 3)], "doc_id long, rater string, grade int")
    got = reading_levels(docs, labels).collect()
    by = {r["doc_id"]: r["level"] for r in got}
    assert len(got) == 124 and by[900] is by[901] is by[902] is None and all(1 <= by[i] <= 5 for i in range(120))
    assert {r["level"] for r in reading_levels(docs, labels.limit(0)).collect()} == {None}
    assert reading_levels(docs.limit(0), labels).count() == 0
    assert reading_levels(docs, labels, only=F.col("doc_id") == 5).count() == 1
