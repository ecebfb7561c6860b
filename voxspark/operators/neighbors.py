"""Relations between voxels and their neighbours: boundaries, shifts, affinities, edges."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..scratch import Scratch
from .blocks import NAMES, Blocks, Region, halo_apply, voxel_schema

BLOCK = (32, 128, 128)


def neighbours(connectivity: int, xy_only: bool = False) -> list[tuple[int, int, int]]:
    """Steps to neighbours that differ in at most `connectivity` coordinates."""
    steps = [s for s in product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, s)) <= connectivity]
    return [s for s in steps if s[0] == 0] if xy_only else steps


def boundaries(df: DataFrame | Blocks, label: str = "label", mode: str = "inner", connectivity: int = 1, xy_only: bool = False, by: Sequence[str] = ("volume",), block: Sequence[int] = BLOCK) -> DataFrame:
    """(by, z, y, x, label, boundary): voxels with a neighbour of another label; neighbours beyond the volume are equal, and so are absent voxels.

    inner: on foreground; outer: on background, and in 3-D also where two objects touch;
    thick: both sides.
    """
    if mode not in ("inner", "outer", "thick"):
        raise ValueError(f"unknown mode {mode!r}")
    steps = neighbours(connectivity, xy_only)

    def find(r: Region) -> pd.DataFrame:
        own = r.arrays[label][r.core]
        differs, touches = np.zeros(own.shape, dtype=bool), np.zeros(own.shape, dtype=bool)
        for s in steps:
            other = r.shifted(r.arrays[label], s)
            unlike = (other != own) & r.shifted(r.present, s)
            differs |= unlike
            touches |= unlike & (other != 0) & (own != 0)
        if mode == "inner":
            differs &= own > 0
        elif mode == "outer":
            differs &= (own == 0) | (touches if not xy_only else False)
        return r.rows(by, **{label: own, "boundary": differs})

    return halo_apply(df, [label], (0 if xy_only else 1, 1, 1), find, voxel_schema(df, by, **{label: T.LongType(), "boundary": T.BooleanType()}), by, block)


def erode_boundaries(df: DataFrame | Blocks, label: str = "label", mode: str = "inner", connectivity: int = 1, pixel_size: Sequence[float] | None = None, by: Sequence[str] = ("volume",)) -> DataFrame:
    """Boundary voxels become background; within sections only, where z is over twice as coarse."""
    flat = pixel_size is not None and pixel_size[0] / min(pixel_size[1:]) > 2
    edge = boundaries(df, label, mode, connectivity, flat, by)
    return edge.withColumn(label, F.when(F.col("boundary"), 0).otherwise(F.col(label)).cast("long")).drop("boundary")


def _reach(offsets: Sequence[Sequence[int]]) -> list[int]:
    return [max(abs(o[k]) for o in offsets) for k in range(3)]


def shift(df: DataFrame | Blocks, offset: Sequence[int], column: str, by: Sequence[str] = ("volume",), block: Sequence[int] = BLOCK) -> DataFrame:
    """(by, z, y, x, column): the value at each voxel moved by the offset, clamped to the volume; voxels whose moved one is absent are left out."""

    def move(r: Region) -> pd.DataFrame:
        if any(abs(o) >= n for o, n in zip(offset, r.shape)):
            raise ValueError("the offset is not smaller than the volume")
        there = r.present[r.core] & r.shifted(r.present, offset)
        return r.rows(by, there, **{column: r.shifted(r.arrays[column], offset)})

    kind = NAMES[df.kinds[column]] if isinstance(df, Blocks) else df.schema[column].dataType
    return halo_apply(df, [column], _reach([offset]), move, voxel_schema(df, by, **{column: kind}), by, block)


def affinities(df: DataFrame | Blocks, offsets: Sequence[Sequence[int]], label: str = "label", background: int | None = None, by: Sequence[str] = ("volume",), block: Sequence[int] = BLOCK, carry: Sequence[str] = ()) -> DataFrame:
    """(by, z, y, x, label, aff, valid, carry): for each offset, whether the moved voxel has the same label, and whether both are foreground.

    All offsets in one pass.  Voxels with the label `background` have no affinity, and none has one to an absent voxel.
    The columns `carry` (numbers) go along in the blocks.
    """

    def compare(r: Region) -> pd.DataFrame:
        own = r.arrays[label][r.core]
        aff, valid = np.empty((len(offsets), *own.shape), np.int8), np.empty((len(offsets), *own.shape), np.int8)
        for k, o in enumerate(offsets):
            other = r.shifted(r.arrays[label], o)
            aff[k] = (own == other) & r.shifted(r.present, o)
            valid[k] = (own > 0) & (other > 0)
            if background is not None:
                aff[k] &= own != background
        return r.rows(by, **{label: own, "aff": aff, "valid": valid}, **{c: r.arrays[c][r.core] for c in carry})

    bits = T.ArrayType(T.ByteType())
    along = {c: NAMES[df.kinds[c]] if isinstance(df, Blocks) else df.schema[c].dataType for c in carry}
    return halo_apply(df, [label, *carry], _reach(offsets), compare, voxel_schema(df, by, **{label: T.LongType(), "aff": bits, "valid": bits}, **along), by, block)


def affinity_targets(df: DataFrame | Blocks, offsets, label: str = "label", background: int | None = None, by: Sequence[str] = ("volume",)) -> DataFrame:
    return affinities(df, offsets, label, background, by).drop("valid")


def affinity_validity(df: DataFrame | Blocks, offsets, label: str = "label", by: Sequence[str] = ("volume",)) -> DataFrame:
    return affinities(df, offsets, label, None, by).drop("aff")


def channel_targets(df: DataFrame | Blocks, offsets, label: str = "label", background: int | None = None, by: Sequence[str] = ("volume",)) -> DataFrame:
    """Affinities and masks in one table, to be kept for all later uses."""
    return affinities(df, offsets, label, background, by)


EDGES = "u long, v long, w double, off int, is_mutex boolean"


def build_edges(df: DataFrame, offsets: Sequence[Sequence[int]], n_pull: int, aff: str = "aff", strides: Sequence[int] = (1, 4, 4), mask: str | None = None, by: Sequence[str] = ("volume",), shapes: DataFrame | None = None) -> DataFrame:
    """Edges (by, u, v, w, off, is_mutex) between voxels inside the volume, from an array of affinities per voxel.

    Pull edges weigh the affinity, push edges (offsets from n_pull on) one minus it in
    single precision.  Push edges are taken on a grid of strides that begins at the
    first voxel that has an edge.  With a mask both ends must be in it.  shapes(by, d, h, w), if
    known, spares a pass over df; one row a volume, they go to the voxels, which don't meet at their volume's key.
    """
    dims = F.broadcast(df.groupBy(*by).agg(*((F.max(a) + 1).alias(n) for a, n in zip("zyx", "dhw"))) if shapes is None else shapes.select(*by, "d", "h", "w"))
    rows = df.where(F.col(mask)) if mask else df
    table = F.array(*(F.struct(F.lit(k).alias("off"), *(F.lit(int(d)).alias(f"d{a}") for a, d in zip("zyx", o))) for k, o in enumerate(offsets)))
    e = rows.join(dims, list(by)).select(*by, "z", "y", "x", "d", "h", "w", F.col(aff).alias("_a"), F.explode(table).alias("_o")).select("*", "_o.*")
    for a, n, s in zip("zyx", "dhw", strides):
        to = F.col(a) + F.col(f"d{a}")
        on_grid = F.pmod(F.col(a) - F.greatest(F.lit(0), -F.col(f"d{a}")), F.lit(s)) == 0
        e = e.where((to >= 0) & (to < F.col(n)) & ((F.col("off") < n_pull) | on_grid))
    flat = lambda z, y, x: (z.cast("long") * F.col("h") + y) * F.col("w") + x
    at, to = [F.col(a) for a in "zyx"], [F.col(a) + F.col(f"d{a}") for a in "zyx"]
    weight = F.element_at("_a", F.col("off") + 1).cast("float")
    mutex = F.col("off") >= n_pull
    e = e.select(*by, flat(*at).alias("u"), flat(*to).alias("v"), F.when(mutex, (F.lit(1).cast("float") - weight)).otherwise(weight).cast("double").alias("w"), "off", mutex.alias("is_mutex"))
    if mask:
        inside = rows.join(dims, list(by)).select(*by, flat(*at).alias("v"))
        e = e.join(inside, [*by, "v"], "left_semi").select(*by, "u", "v", "w", "off", "is_mutex")
    return e


def _cut(rows: DataFrame, group: Sequence[str], values: Sequence[str], wanted: DataFrame) -> DataFrame:
    """For each group the values, in order, among whose rows the last wanted one is, and how many of these are wanted: wanted(group, want) -> (group, _b*, want).

    Groups with no more rows than wanted are left out.
    """
    counts = rows.groupBy(*group, *values).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy(*values).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = _with(counts.withColumn("_upto", upto), wanted, group)
    last = at.where((F.col("_upto") >= F.col("want")) & (F.col("_upto") - F.col("_n") < F.col("want")))
    return last.select(*group, *(F.col(v).alias(f"_b{i}") for i, v in enumerate(values)), (F.col("want") - F.col("_upto") + F.col("_n")).alias("want"))


def _with(rows: DataFrame, other: DataFrame, group: Sequence[str], how: str = "inner") -> DataFrame:
    """rows joined to a table of one row a group; null groups are groups."""
    named = other.withColumnsRenamed({g: f"_of_{g}" for g in group})
    return rows.join(named, [rows[g].eqNullSafe(named[f"_of_{g}"]) for g in group], how).drop(*(f"_of_{g}" for g in group))


def cap_push_edges(edges: DataFrame, k: int, by: Sequence[str] = (), bins: int = 4096, scratch: Scratch | None = None) -> DataFrame:
    """All pull edges and the k push edges of largest weight, ties by (off, u); with `by`, k of each group (crop).

    Nothing is sorted as a whole: a histogram of weights gives the bin with the last edge that
    stays, counts of the different weights in that bin the last weight, a histogram of voxels the last voxels of that
    weight; only edges of one weight and one range of voxels are ranked.
    """
    scratch = scratch or Scratch(edges.sparkSession, "cap")
    group = list(by) or ["_all"]
    push = edges.where("is_mutex") if by else edges.where("is_mutex").withColumn("_all", F.lit(0))
    heavy = F.least(F.greatest(F.floor((1 - F.col("w")) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    push = scratch.keep(push.withColumns({"_bin": heavy, "_light": -F.col("w")}), "push")
    ends = push.groupBy(*group).agg(F.max("u").alias("_last"))
    push = _with(push, ends, group).withColumn("_range", F.floor(F.col("u") / (F.col("_last") + 1) * bins).cast("int")).drop("_last")
    wanted, rows, out = ends.select(*group, F.lit(k).cast("long").alias("want")), push, edges.where("NOT is_mutex")
    if k <= 0:
        return out
    for values in (["_bin"], ["_light", "off"], ["_range"]):
        cut = scratch.keep(_cut(rows, group, values, wanted), "cut")
        marked = _with(rows, cut, group, "left")
        here, border = F.struct(*values), F.struct(*(F.col(f"_b{i}") for i in range(len(values))))
        out = out.unionByName(marked.where(F.col("want").isNull() | (here < border)).select(edges.columns))
        rows = scratch.keep(marked.where(F.col("want").isNotNull() & (here == border)).select(push.columns), "border")
        wanted = cut.select(*group, "want")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("u"))
    last = _with(rows.withColumn("_r", rank), wanted, group).where(F.col("_r") <= F.col("want"))
    return out.unionByName(last.select(edges.columns))
