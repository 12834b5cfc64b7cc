import json

import pytest

from lectern.operators import reports
from lectern.sources.judgements import cached_output, read_judgements, read_sample
from lectern.sources.uploads import import_new, read_uploads

GOOD = b"%PDF-1.7\n1 0 obj << /Type /Pages /Kids [] >> endobj\ntrailer\n%%EOF\n"


def test_uploads(spark, tmp_path):
    for name, content in {"a.PDF": GOOD, "b.pdf": GOOD, "c.pdf": b"hello", "d.pdf": GOOD + b"x" * 5000, "e.pdf": b"", "f.pdf": GOOD.replace(b"1.7", b"1.4")}.items():
        (tmp_path / name).write_bytes(content)
    up = read_uploads(spark, str(tmp_path), most_bytes=1000)
    by = {r["name"]: r for r in up.collect()}
    assert {n: r["error"] for n, r in by.items()} == {"a": None, "b": None, "c": "not a document", "d": "too large", "f": None}
    stored = spark.createDataFrame([(by["f"]["sha256"],), (None,)], "pdf_sha256 string")
    assert [r["name"] for r in import_new(up, stored).collect()] == ["a"]


def test_judgements_and_samples(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"x": {"excerpt": "e", "score": 1}, "y": {"score": 0}}))
    (tmp_path / "2.json").write_text(json.dumps({"x": {"excerpt": "e", "score": 2}}))
    got = {r["key"]: r["score"] for r in read_judgements(spark, str(tmp_path)).collect()}
    assert got == {"x": 2, "y": 0}
    toml = '[[source]]\nname="s"\nsha256="h"\npages=9\n[[excerpt]]\nname="e"\nsource="s"\nfirst_page=2\nlast_page=%d\n'
    (tmp_path / "ids.toml").write_text(toml % 4)
    sources, excerpts = read_sample(spark, str(tmp_path / "ids.toml"))
    assert sources.count() == 1 and excerpts.first()["last_page"] == 4
    (tmp_path / "ids.toml").write_text(toml % 10)
    with pytest.raises(ValueError):
        read_sample(spark, str(tmp_path / "ids.toml"))


def test_cache_and_reports(spark):
    want = spark.createDataFrame([("a",), ("b",)], "sha256 string")
    cache = spark.createDataFrame([("a", "p", "1", "{}"), ("b", "p", "2", "{}")], "sha256 string, parser string, parser_version string, raw string")
    hits, misses = cached_output(want, cache, "p", "1")
    assert [r["sha256"] for r in hits.collect()] == ["a"] and [r["sha256"] for r in misses.collect()] == ["b"]
    scores = spark.createDataFrame([("g", "m", 1), ("g", "m", 2), ("h", "n", 4)], "g string, p string, s int")
    text = reports.markdown_table(reports.pivoted(scores, "g", "p", ["m", "n"], "s").orderBy("g"))
    assert text.split("\n")[2] == "|  | 1.5 | 4.0 |"
    with pytest.raises(ValueError):
        reports.markdown_table(scores, rows=2)
