"""Every named query against its SQL on the smallest tables; the others must run and repeat."""
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from provena.plans import programs, queries as own  # noqa: F401  (programs adds to the registry)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


def against(spark, data, frame, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    rel = con.sql(sql)
    cols = sorted(frame.columns)
    assert cols == sorted(rel.columns)
    mine = sorted(repr([plain(r[c]) for c in cols]) for r in frame.collect())
    theirs = sorted(repr([plain(r[rel.columns.index(c)]) for c in cols]) for r in rel.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_against_sql(spark, data, name):
    against(spark, data, own.QUERIES[name](spark, data), own.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLES)))
def test_runs_and_repeats(spark, data, name):
    a, b = (sorted(map(repr, own.QUERIES[name](spark, data).collect())) for _ in range(2))
    assert a == b


def test_entry_survives_without_llm(tmp_path):
    """A copy without the subpackage and its pipeline imports and has all other queries; another missing module is an error."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ask = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.own.QUERIES), set(e.oracle_sql()) <= set(e.queries()), 'pipeline' in e.queries())"
    run = lambda: subprocess.run([sys.executable, "-c", ask], cwd=tmp_path / "r", env=env, capture_output=True, text=True)
    assert run().stdout.split() == ["True", "True", "False"]
    os.remove(tmp_path / "r" / "provena" / "sources" / "tables.py")
    assert "ModuleNotFoundError" in run().stderr
