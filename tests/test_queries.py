"""Every query with SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tonelake import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    ours = plain(catalog.queries()[name](spark, SF).toPandas())
    theirs = plain(duck.execute(catalog.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(ours, theirs)
