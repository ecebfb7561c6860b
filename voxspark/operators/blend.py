"""Overlapping windows: grid, weights, scoring by a user's function, blending."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .tiling import AXES, SIZES, extract_patches


def gaussian_weight(patch: Sequence[int], sigma_scale: float = 0.125, local: Sequence[str] = ("lz", "ly", "lx")) -> Column:
    """Weight of local coordinates: a Gaussian around patch / 2, 1 at its largest voxel."""
    sigma = min(patch) * sigma_scale
    top = sum((round(p / 2) - p / 2) ** 2 for p in patch)  # the voxel nearest to the centre
    far = sum(((F.col(c) - p / 2) * (F.col(c) - p / 2) for c, p in zip(local, patch)), F.lit(0.0))
    return F.exp((F.lit(top) - far) / (2 * sigma * sigma))


def mirrored(at: Column, n: Column) -> Column:
    """The place of an axis of n voxels that a place beyond its end mirrors; the last voxel is not repeated."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    k = F.pmod(at, period)
    return F.when(n == 1, F.lit(0)).otherwise(F.least(k, period - k)).cast("int")


def padded_sizes(volumes: DataFrame, patch: Sequence[int], stride: Sequence[int] | None = None) -> DataFrame:
    """volumes with pd, ph, pw: the sizes that whole strides of the patch need."""
    need = {}
    for n, p, s in zip(SIZES, patch, stride or [max(1, p // 2) for p in patch]):
        need[f"p{n}"] = (F.ceil(F.greatest(F.col(n) - p, F.lit(0)) / s) * s + p).cast("int")
    return volumes.withColumns(need)


def reflect_pad(voxels: DataFrame, volumes: DataFrame, patch: Sequence[int], stride: Sequence[int] | None = None) -> DataFrame:
    """Voxels of volumes(volume, d, h, w) with mirror images behind their far faces, up to whole strides of the patch.

    Each voxel gives its own images; only those near enough to a face have any.
    """
    sizes = padded_sizes(volumes.select("volume", *SIZES), patch, stride)
    out = voxels.join(F.broadcast(sizes), "volume")  # one row a volume
    for a, n in zip(AXES, SIZES):
        images = F.filter(F.sequence(F.least(F.col(n), F.col(f"p{n}") - 1), F.col(f"p{n}") - 1), lambda i: (i >= F.col(n)) & (mirrored(i, F.col(n)) == F.col(a)))  # noqa: B023
        out = out.withColumn(a, F.explode(F.concat(F.array(F.col(a).cast("int")), F.transform(images, lambda i: i.cast("int")))))
    return out.select(voxels.columns)


def window_grid(volumes: DataFrame, patch: Sequence[int], stride: Sequence[int] | None = None, grid: str = "cover") -> DataFrame:
    """Windows (volume, z, y, x); "cover" adds a last one at the far face, "floor" keeps whole strides only, "reflect"
    goes on in whole strides beyond the far face, where :func:`reflect_pad` fills in."""
    if grid not in ("cover", "floor", "reflect"):
        raise ValueError(f"unknown grid {grid!r}")
    df = volumes
    if grid == "reflect":
        df = padded_sizes(volumes, patch, stride)
        for a, n, p, s in zip(AXES, SIZES, patch, stride or [max(1, p // 2) for p in patch]):
            df = df.withColumn(a, F.explode(F.sequence(F.lit(0), F.col(f"p{n}") - p, F.lit(s))))
        return df.select("volume", *AXES)
    for a, n, p, s in zip(AXES, SIZES, patch, stride or [max(1, p // 2) for p in patch]):
        size = F.greatest(F.col(n), F.lit(p))  # shorter axes are padded
        count = F.greatest(F.lit(1), F.floor((F.col(n) - p + s) / s))
        at = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.least(i * s, size - p).cast("int"))  # noqa: B023
        if grid == "cover":
            at = F.array_union(at, F.array((size - p).cast("int")))
        df = df.withColumn(a, F.explode(F.array_distinct(at)))
    return df.select("volume", *AXES)


def score_patches(patches: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """fn, a user's model, applied to batches of patch rows."""

    def run(frames):
        for pdf in frames:
            out = fn(pdf)
            if not isinstance(out, pd.DataFrame):
                raise TypeError(f"the model must return a table of predictions, not {type(out).__name__}")
            yield out

    return patches.mapInPandas(run, schema)


def blend_patches(scored: DataFrame, value: str, patch: Sequence[int], aggregation: str = "gaussian", floor_zero: bool = False, by: Sequence[str] = ("volume",)) -> DataFrame:
    """One value for each voxel (by, z, y, x) from scored(by, z, y, x, lz, ly, lx, value)."""
    if aggregation == "max":
        top = F.max(value)
        return scored.groupBy(*by, *AXES).agg((F.greatest(top, F.lit(0.0)) if floor_zero else top).alias(value))
    if aggregation not in ("gaussian", "average"):
        raise ValueError(f"unknown aggregation {aggregation!r}")
    w = gaussian_weight(patch) if aggregation == "gaussian" else F.lit(1.0)
    return scored.groupBy(*by, *AXES).agg((F.sum(F.col(value) * w) / (F.sum(w) + 1e-8)).alias(value))


def slide(voxels: DataFrame, volumes: DataFrame, value: str, fn: Callable[[pd.DataFrame], pd.DataFrame], patch: Sequence[int], stride: Sequence[int] | None = None, aggregation: str = "gaussian", grid: str = "reflect") -> DataFrame:
    """(volume, z, y, x, value): fn over all windows of volumes(volume, d, h, w), blended and cut to the volumes.

    fn takes all rows (volume, wz, wy, wx, lz, ly, lx, value) of one window and gives them back with
    its values: w* is the window's place, l* the voxel's place in it.
    """
    source = voxels.select("volume", *AXES, value)
    source = reflect_pad(source, volumes, patch, stride) if grid == "reflect" else source
    windows = window_grid(volumes, patch, stride, grid).withColumns({**{f"w{a}": F.col(a) for a in AXES}, **{f"s{a}": F.lit(p) for a, p in zip(AXES, patch)}})
    rows = extract_patches(source, windows).select("volume", *(f"w{a}" for a in AXES), *(F.col(a).alias(f"l{a}") for a in AXES), value)
    kinds = [f"volume {voxels.schema['volume'].dataType.simpleString()}", *(f"{k}{a} int" for k in "wl" for a in AXES), f"{value} double"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf)
        if not isinstance(out, pd.DataFrame):
            raise TypeError(f"the model must return a table of predictions, not {type(out).__name__}")
        return out

    scored = rows.groupBy("volume", *(f"w{a}" for a in AXES)).applyInPandas(run, ", ".join(kinds))
    inside = scored.withColumns({a: F.col(f"w{a}") + F.col(f"l{a}") for a in AXES}).join(F.broadcast(volumes.select("volume", *SIZES)), "volume")  # one row a volume
    for a, n in zip(AXES, SIZES):
        inside = inside.where(F.col(a) < F.col(n))
    return blend_patches(inside, value, patch, aggregation)
