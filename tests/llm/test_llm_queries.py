"""The queries that SQL can express, against DuckDB."""

import pytest

from colloquy.llm.oracles import SQL
from colloquy.llm.queries import QUERIES


@pytest.mark.parametrize("name", SQL)
def test_query(spark, name):
    import duckdb

    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(SQL[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda f: sorted(tuple(str(v).removesuffix(".0") for v in r) for r in f[columns].astype(object).where(f[columns].notna(), "").itertuples(index=False))
    assert plain(got) == plain(want)


def test_all_operators_have_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
