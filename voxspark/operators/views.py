"""Look-ups behind a viewer: slices, labels, palettes, coarser volumes, overlays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

AXES, SIZES = ("z", "y", "x"), ("d", "h", "w")


def slice_axis(voxels: DataFrame, volumes: DataFrame, axis: int, index: int) -> DataFrame:
    """The plane (volume, row, col, ...) at an index along an axis, clamped to the volume."""
    if axis not in (0, 1, 2):
        raise ValueError(f"no axis {axis}")
    at = F.least(F.greatest(F.lit(index), F.lit(0)), F.col(SIZES[axis]) - 1)
    plane = voxels.join(volumes.select("volume", SIZES[axis]), "volume").where(F.col(AXES[axis]) == at).drop(SIZES[axis], AXES[axis])
    rest = [a for k, a in enumerate(AXES) if k != axis]
    return plane.withColumnsRenamed(dict(zip(rest, ("row", "col"))))


def label_at(voxels: DataFrame, volumes: DataFrame, points: DataFrame, label: str) -> DataFrame:
    """Labels at points(i, volume, z, y, x), clamped; 0 without a segmentation."""
    p = points.join(volumes, "volume")
    for a, n in zip(AXES, SIZES):
        p = p.withColumn(a, F.least(F.greatest(F.col(a), F.lit(0)), F.col(n) - 1))
    got = p.select("i", "volume", *AXES).join(voxels.select("volume", *AXES, label), ["volume", *AXES], "left")
    return got.select("i", F.coalesce(label, F.lit(0)).cast("long").alias("label"))


def label_list(voxels: DataFrame, label: str) -> DataFrame:
    return voxels.where(F.col(label) > 0).select("volume", F.col(label).alias("label")).distinct()


def palette(ids: DataFrame, label: str = "label", seed: int = 0) -> DataFrame:
    """Colours of 60..255 a channel from a hash of the id; id 0 stays without."""
    channel = lambda k: (60 + F.pmod(F.xxhash64(F.lit(seed), F.lit(k), label), F.lit(196))).cast("int")
    return ids.where(F.col(label) > 0).withColumns({"r": channel(0), "g": channel(1), "b": channel(2)})


def downsample(voxels: DataFrame, k: int) -> DataFrame:
    """Every k-th voxel of each axis, 1 to 16."""
    if not 1 <= k <= 16:
        raise ValueError("the step must be 1 to 16")
    kept = voxels
    for a in AXES:
        kept = kept.where(F.col(a) % k == 0)
    return kept.withColumns({a: F.floor(F.col(a) / k).cast("int") for a in AXES})


def seg_rgba(voxels: DataFrame, colours: DataFrame, label: str) -> DataFrame:
    """Colour and alpha of each voxel: 255 on objects, 0 elsewhere."""
    on = voxels.join(colours.withColumnRenamed("label", label), label, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return on.select("volume", *AXES, label, zero("r"), zero("g"), zero("b"), F.when(F.col(label) > 0, 255).otherwise(0).alias("a"))


def seg_mod256(voxels: DataFrame, label: str) -> DataFrame:
    return voxels.withColumn("id8", F.pmod(label, F.lit(256)).cast("int"))


def overlay(rgba: DataFrame, grey: str, label: str, opacity: float, selected: Sequence[int] | None = None) -> DataFrame:
    """Grey values 0..255 under the colours; ids that are not selected show 0.15 of the opacity."""
    alpha = F.lit(opacity) if selected is None else F.when(F.col(label).isin(list(selected)), opacity).otherwise(0.15 * opacity)
    alpha = F.when(F.col(label) > 0, alpha).otherwise(0.0)
    mix = lambda c: F.least(F.greatest((1 - alpha) * F.col(grey) + alpha * F.col(c), F.lit(0.0)), F.lit(255.0)).cast("int")
    return rgba.withColumns({c: mix(c) for c in "rgb"})


def central_slice(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    return voxels.join(volumes.select("volume", "d"), "volume").where(F.col("z") == F.floor(F.col("d") / 2)).drop("d")


def hue(label: Column) -> Column:
    """Golden-ratio hue of an id."""
    x = label * 0.6180339887498949
    return x - F.floor(x)


def label_to_rgb(label: str, seed: int = 0) -> list[Column]:
    """r, g, b in [0, 1] with a hashed saturation and value; 0 is black."""
    part = lambda k, lo, hi: lo + (hi - lo) * F.pmod(F.xxhash64(F.lit(seed), F.lit(k), label), F.lit(1000)) / 1000
    s, v, h = part(0, 0.6, 1.0), part(1, 0.7, 1.0), hue(F.col(label)) * 6
    channel = lambda n: v - v * s * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least((F.lit(n) + h) % 6, 4 - (F.lit(n) + h) % 6)))
    return [F.when(F.col(label) == 0, 0.0).otherwise(channel(n)).alias(c) for n, c in ((5, "r"), (3, "g"), (1, "b"))]


def panel_indices(n_offsets: int, n_pull: int, max_push: int | None = None) -> list[int]:
    """Affinity channels to show: all, or the pull ones and every (n_push // max_push)-th push one."""
    push = range(n_pull, n_offsets)
    if max_push is None or len(push) <= max_push:
        return list(range(n_offsets))
    return [*range(n_pull), *push[:: max(1, len(push) // max_push)]][: n_pull + max_push]


def masked_panels(df: DataFrame, indices: Sequence[int], seg: str = "seg", sem: str = "sem", aff: str = "aff", label: str = "label") -> DataFrame:
    """The segmentation where the semantic mask holds, and chosen affinities on the foreground."""
    chosen = F.array(*(F.element_at(aff, i + 1) for i in indices))
    fg = (F.col(label) > 0).cast("double")
    return df.withColumns({"seg_masked": F.when(F.col(sem), F.col(seg)).otherwise(0), "aff_masked": F.transform(chosen, lambda a: a * fg)})
