"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from chartmill import queries

DIR = "/root/testdata/sf0.001"
NAMES = sorted(queries.queries())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    return str(int(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert got == want


def test_entry_imports_without_the_subpackage(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def blocked(name, *a, **k):
        if name in ("corpus_pipeline",) or name.startswith("chartmill.llm"):
            raise ImportError(name)
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m.startswith(("chartmill.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", blocked)
    e = importlib.import_module("__spark_entry__")
    assert set(e.queries()) == set(queries.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
