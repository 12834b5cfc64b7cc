import re

import __spark_entry__ as entry


def test_registration():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert sql.keys() <= queries.keys() and "rrf_search" in queries and "p5_found" in queries
    assert all(re.fullmatch(r"[a-z0-9_]+", n) and callable(f) for n, f in queries.items())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_type", "item_id", "score", "n_channels"] and 0 < df.count() <= 10
