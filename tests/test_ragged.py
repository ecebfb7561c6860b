"""Queries over a volume whose last section ends early give the rows of their SQL."""

import os

import duckdb
import pandas as pd
import pytest

from voxspark.plans import graph_queries, registry, segmentation_queries, volume_queries  # noqa: F401

from .test_queries import TABLES


@pytest.fixture(scope="module")
def ragged(sf_dir, tmp_path_factory):
    """Folders of the given tables with fewer vectors: the last section holds six rows and begins a sample, or follows in one."""

    def cut(n: int):
        folder = tmp_path_factory.mktemp(f"ragged{n}")
        for t in TABLES:
            if t != "embeddings":
                os.symlink(f"{sf_dir}/{t}.parquet", f"{folder}/{t}.parquet")
        duckdb.sql(f"COPY (SELECT * FROM '{sf_dir}/embeddings.parquet' WHERE vec_id < {n}) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        return str(folder), con

    return {n: cut(n) for n in (256, 306)}


def check(spark, ragged, name, n):
    folder, con = ragged[n]
    got, want = registry.QUERIES[name](spark, folder).toPandas(), con.execute(registry.ORACLES[name]).df()
    keys = [c for c in ("sample_id", "i", "z", "y", "x") if c in want]
    in_order = lambda df: df[sorted(want.columns)].sort_values(keys).reset_index(drop=True)
    assert len(want)
    pd.testing.assert_frame_equal(in_order(got), in_order(want), check_dtype=False, rtol=0, atol=2e-6)


@pytest.mark.parametrize("n", [256, 306])
@pytest.mark.parametrize("name", ["boundaries_3d", "boundaries_xy", "boundary_mask_batch", "erode_boundaries", "sem_label_copy"])
def test_absent_neighbours_make_no_boundary(spark, ragged, name, n):
    check(spark, ragged, name, n)


@pytest.mark.parametrize("n", [256, 306])
def test_shift_to_absent_voxels_gives_no_row(spark, ragged, n):
    check(spark, ragged, "shift_nd", n)


@pytest.mark.parametrize("n", [256, 306])
def test_smoothing_reaches_absent_voxels(spark, ragged, n):
    check(spark, ragged, "gaussian_filter", n)


@pytest.mark.parametrize("n", [256, 306])
def test_foreground_is_a_share_of_the_present_voxels(spark, ragged, n):
    check(spark, ragged, "foreground_crop", n)


@pytest.mark.parametrize("n", [256, 306])
@pytest.mark.parametrize("name", ["zoom_samples", "augment_pipeline", "augment_validation"])
def test_samples_that_lack_voxels(spark, ragged, name, n):
    check(spark, ragged, name, n)
