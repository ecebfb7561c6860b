"""Distances, smoothing and centres of regions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .blocks import Region, halo_apply, voxel_schema
from .lines import edt  # noqa: F401

AXES = ("z", "y", "x")


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2) if sigma > 0 else np.ones(1)
    return k / k.sum()


def gaussian_filter(df: DataFrame, value: str, sigma: Sequence[float], truncate: float = 4.0, by: Sequence[str] = ("volume",), block: Sequence[int] = (32, 128, 128)) -> DataFrame:
    """Separable smoothing; the volume is mirrored at its faces, face voxels included.

    Absent voxels add nothing, and those that a present one reaches get a value too.
    """
    kernels = [gaussian_kernel(s, truncate) for s in sigma]

    def smooth(r: Region) -> pd.DataFrame:
        a, there = np.where(r.present, r.arrays[value], 0).astype(np.float64), r.present
        for k, kernel in enumerate(kernels):
            half = len(kernel) // 2
            at = np.arange(r.core[k].start, r.core[k].stop) + r.origin[k]
            total, reached = 0.0, False
            for d, w in zip(range(-half, half + 1), kernel):
                j = np.mod(at + d, 2 * r.shape[k])
                j = np.where(j < r.shape[k], j, 2 * r.shape[k] - 1 - j) - r.origin[k]
                total = total + w * np.take(a, j, axis=k)
                reached = reached | np.take(there, j, axis=k)
            a, there = total, reached
        return r.rows(by, there, **{value: a})

    halo = [len(k) // 2 for k in kernels]
    return halo_apply(df, [value], halo, smooth, voxel_schema(df, by, **{value: T.DoubleType()}), by, block)


def centroids(df: DataFrame, label: str = "label", ids: DataFrame | None = None, by: Sequence[str] = ("volume",)) -> DataFrame:
    """Mean coordinates of each label above 0; of ids(label) if given, null where absent."""
    c = df.where(F.col(label) > 0).groupBy(*by, label).agg(*(F.avg(a).alias(f"c{a}") for a in AXES))
    return ids.join(c, [label], "left") if ids is not None else c
