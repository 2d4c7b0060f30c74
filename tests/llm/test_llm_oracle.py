"""Every registered training-data query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from covarix.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(x):
    return round(x, 9) + 0.0 if isinstance(x, float) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    got = rows_of(df.columns, df.collect())
    assert got and got == rows_of(names, want.fetchall())
