"""Values at the borders of the labels are labelled as in SQL, which compares them in single precision."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from voxspark.plans import graph_queries, registry, segmentation_queries, volume_queries  # noqa: F401

from .test_queries import TABLES, rows

NAMES = "boundaries_xy boundaries_xy_outer erode_boundaries extract_patches grow_labels missing_section_mean missing_section_nearest missing_section_zero sem_label_copy write_volume prepare_labels".split()


@pytest.fixture(scope="module")
def borders(sf_dir, tmp_path_factory):
    """Folder of the given tables whose first two sections hold the numbers at and next to the borders."""
    folder = tmp_path_factory.mktemp("borders")
    for t in TABLES:
        if t != "embeddings":
            os.symlink(f"{sf_dir}/{t}.parquet", f"{folder}/{t}.parquet")
    near = [np.nextafter(np.float32(b), np.float32(to)) for b in (-0.1, -0.12) for to in (b, -1, 1)]
    table = pd.DataFrame({"vec_id": range(100), "embedding": [[float(near[(i + k) % 6]) for k in range(64)] for i in range(100)]})
    duckdb.sql(f"COPY (SELECT vec_id, CAST(embedding AS FLOAT[]) AS embedding, 0 AS label FROM \"table\") TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_borders(spark, borders, name):
    folder, con = borders
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, folder).toPandas()
    pd.testing.assert_frame_equal(rows(got[sorted(want.columns)]), rows(want), check_dtype=False)
