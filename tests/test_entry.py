"""The driver's functions, and every query against its SQL."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from modlens.plans import registry

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if pd.isna(v):
            return "null"
        if isinstance(v, (bool, str)):
            return str(v)
        try:
            return f"{float(v):.9g}"
        except (TypeError, ValueError):
            return str(pd.Timestamp(v))

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, str(SF)).toPandas()
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, str(SF)).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_imports_without_the_subpackage():
    code = "import sys; sys.modules['modlens.llm'] = None; import __spark_entry__ as e; assert 'h5_risk_users' in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
