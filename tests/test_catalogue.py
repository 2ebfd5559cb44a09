"""Every catalogued query against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from brindle.plans import catalogue

DIR = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DIR.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canonical(rows, names, columns):
    order = [names.index(c) for c in columns]
    return sorted(repr(tuple(r[k] for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DIR))
    columns = sorted(df.columns)
    got = canonical([tuple(r) for r in df.collect()], df.columns, columns)
    if name not in catalogue.ORACLE:
        assert got
        return
    r = duck.execute(catalogue.ORACLE[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == columns
    assert got == canonical(r.fetchall(), names, columns)


def test_entry_without_the_training_data_subpackage():
    import importlib.util
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    block = "import sys\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert 'flagship_search' in e.queries() and not [q for q in e.queries() if q.startswith('op')]\nassert set(e.oracle_sql()) <= set(e.queries())"
    assert importlib.util.find_spec("pyspark")
    subprocess.run([sys.executable, "-c", block], cwd=root, check=True, timeout=120)
