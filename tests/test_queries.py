"""Every query against its SQL in DuckDB, and the entry module without the training-data operators."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from colloquy.plans.oracles import SQL
from colloquy.plans.queries import QUERIES

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(frame):
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(text, r)) for r in frame[columns].itertuples(index=False))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, sf_dir, name):
    assert plain(QUERIES[name](spark, sf_dir).toPandas()) == plain(duck.execute(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_library_stands_without_training_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(TOP, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(q) == set(e.oracle_sql()), q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
    assert out.returncode == 0 and int(out.stdout.split()[-1]) == len(QUERIES), out.stderr[-500:]


def test_nothing_imports_training_operators():
    for path in glob.glob(f"{TOP}/colloquy/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "colloquy.llm" not in open(path).read(), path
