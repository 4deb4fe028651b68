"""Every query with SQL against DuckDB on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tidewatch.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted("|".join("null" if pd.isna(v) else f"{v:.4f}" if isinstance(v, float) else str(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, sf_dir, name):
    ours = registry.queries()[name](spark, sf_dir).toPandas()
    if name not in registry.oracle_sql():
        assert len(ours)
        return
    theirs = con.execute(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours)
    assert plain(ours) == plain(theirs)
