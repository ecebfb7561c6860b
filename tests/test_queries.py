"""Every query runs; those with SQL give the same rows in DuckDB."""

import duckdb
import pandas as pd
import pytest

from voxspark.plans import graph_queries, registry, segmentation_queries, volume_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None).map(lambda v: v if v is None or isinstance(v, str) else round(float(v), 5))
    return df.sort_values(list(df.columns), key=lambda c: c.map(repr)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got)
    if name in registry.ORACLES:
        want = sql.execute(registry.ORACLES[name]).df()
        pd.testing.assert_frame_equal(rows(got[sorted(want.columns)]), rows(want), check_dtype=False)
