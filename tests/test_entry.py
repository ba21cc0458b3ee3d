import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
#: Queries that are small enough to run here one by one; the driver runs all of them.
CHOSEN = ["clean_string", "synonym_replace", "accuracy_metrics", "class_report", "bm25_topk", "zscore_gap", "index_diff", "user_context", "polygon_filter", "p3_found", "p5_found"]


def test_names():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 100


@pytest.mark.parametrize("name", CHOSEN)
def test_against_sql(spark, sf, name):
    from pathlib import Path

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    mine = sorted(map(repr, (tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in got.select(cols).collect())))
    theirs = sorted(map(repr, (tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})").fetchall())))
    assert mine == theirs and mine


def test_flagship(spark):
    df = entry.entry(spark)
    assert "match_found" in df.columns and df.count() > 0
