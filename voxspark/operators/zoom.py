"""Samples on finer or coarser grids, each with factors of its own, as gathers between blocks.

A target block needs a box of its sample's source; a source block sends each target block
the part of that box that it holds.  Interpolation then runs axis by axis on arrays.
Every sample keeps its size: a larger grid is cut to its centre, a smaller one padded by zeros.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .blocks import AXES, Blocks, block_rows

SIZES = ("d", "h", "w")


def grid(n: int, factor: float) -> tuple[int, int]:
    """Size of the new grid along an axis, and the place in it of the sample's first voxel (negative: padding)."""
    new = max(1, round(n * factor))
    return new, (new - n) // 2 if new >= n else -((n - new) // 2)


def taps(lo: int, hi: int, n: int, factor: float, linear: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For voxels lo..hi-1 of an axis: whether they lie in the new grid, both source voxels, and the second one's weight."""
    new, first = grid(n, factor)
    j = np.arange(lo, hi, dtype=np.int64) + first
    inside = (j >= 0) & (j < new)
    if not linear:
        low = np.clip(j * n // new, 0, n - 1)
        return inside, low, low, np.zeros(len(j))
    at = np.maximum((j + 0.5) * (n / new) - 0.5, 0.0)
    low = np.clip(np.floor(at).astype(np.int64), 0, n - 1)
    return inside, low, np.minimum(low + 1, n - 1), at - low


def _need(cell: int, b: int, n: int, factor: float) -> tuple[int, int]:
    """The source voxels (from, to) that a target block needs along an axis, for values and labels; beyond the new grid those at its ends."""
    lo, hi = cell * b, min((cell + 1) * b, n)
    ends = [(low.min(), high.max() + 1) for linear in (True, False) for _, low, high, _ in (taps(lo, hi, n, factor, linear),)]
    return int(min(e[0] for e in ends)), int(max(e[1] for e in ends))


def zoom_samples(voxels: DataFrame | Blocks, factors: DataFrame, values: Sequence[str] = ("val",), labels: Sequence[str] = ("label",), by: Sequence[str] = ("sample_id",), block: Sequence[int] = (32, 128, 128), sizes: DataFrame | None = None) -> DataFrame:
    """(by, z, y, x, values, labels) of samples under factors(by, zoom_z, zoom_y, zoom_x): values trilinear with half-voxel centres, labels from the nearest voxel.

    Samples without factors, or with null ones, stay as they are.  sizes(by, d, h, w) hold for samples whose last voxels may
    be absent.  A voxel is absent where its nearest one is; absent voxels add nothing to a value.
    """
    columns = [*values, *labels, "present"]
    packed, kinds = block_rows(voxels, [*values, *labels], by, block)
    kinds = kinds | {"present": "?"}
    if sizes is not None:
        given = sizes.select(*(F.col(c).alias(f"_{c}") for c in by), *(F.col(n).cast("long").alias(n) for n in SIZES))
        packed = packed.drop(*SIZES).join(given, [packed[c].eqNullSafe(given[f"_{c}"]) for c in by]).drop(*(f"_{c}" for c in by))
    cells, zooms = [f"b{a}" for a in AXES], [f"zoom_{a}" for a in AXES]
    of = factors.select(*(F.col(c).alias(f"_{c}") for c in by), *(F.col(z).cast("double").alias(z) for z in zooms))
    packed = packed.join(of, [packed[c].eqNullSafe(of[f"_{c}"]) for c in by], "left").drop(*(f"_{c}" for c in by)).fillna(1.0, zooms)
    slab = T.StructType(
        [packed.schema[c] for c in by] + [T.StructField(c, T.IntegerType()) for c in cells] + [T.StructField(c, T.LongType()) for c in SIZES]
        + [T.StructField(c, T.DoubleType()) for c in zooms] + [T.StructField("part", T.ArrayType(T.IntegerType()))] + [T.StructField(c, T.BinaryType()) for c in columns]
    )

    def send(frames):
        for pdf in frames:
            for row in pdf.to_dict("records"):
                shape, factor = [int(row[n]) for n in SIZES], [row[z] for z in zooms]
                own = [row[c] for c in cells]
                wanted = [[(t, _need(t, b, n, f)) for t in range(-(-n // b))] for b, n, f in zip(block, shape, factor)]
                hit = [[(t, max(lo, o * b), min(hi, (o + 1) * b)) for t, (lo, hi) in w if lo < (o + 1) * b and hi > o * b] for w, o, b in zip(wanted, own, block)]
                out = []
                for to in product(*hit):
                    cut = tuple(slice(i - o * b, j - o * b) for (_, i, j), o, b in zip(to, own, block))
                    part = [i for _, i, _ in to] + [j for *_, j in to]
                    arrays = {c: np.frombuffer(row[c], dtype=kinds[c]).reshape(block)[cut].tobytes() for c in columns}
                    out.append({c: row[c] for c in (*by, *SIZES, *zooms)} | dict(zip(cells, (t for t, *_ in to))) | {"part": part} | arrays)
                if out:
                    yield pd.DataFrame(out)[slab.names]

    out_type = lambda c: T.DoubleType() if c in values else T.LongType()
    schema = T.StructType([packed.schema[c] for c in by] + [T.StructField(a, T.IntegerType()) for a in AXES] + [T.StructField(c, out_type(c)) for c in columns[:-1]])

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shape, factor, cell = [int(pdf[n].iloc[0]) for n in SIZES], [float(pdf[z].iloc[0]) for z in zooms], key[-3:]
        need = [_need(c, b, n, f) for c, b, n, f in zip(cell, block, shape, factor)]
        begin, end = [c * b for c, b in zip(cell, block)], [min((c + 1) * b, n) for c, b, n in zip(cell, block, shape)]
        size = [j - i for i, j in zip(begin, end)]
        result, there = {}, True
        for c in columns:
            a = np.zeros([j - i for i, j in need], dtype=kinds[c])
            for row in pdf.to_dict("records"):
                p, q = row["part"][:3], row["part"][3:]
                a[tuple(slice(i - o, j - o) for i, j, (o, _) in zip(p, q, need))] = np.frombuffer(row[c], dtype=kinds[c]).reshape([j - i for i, j in zip(p, q)])
            if c == "present":
                reached = a
                for k in range(3):
                    near, (low, high) = taps(begin[k], end[k], shape[k], factor[k], False)[1], taps(begin[k], end[k], shape[k], factor[k], True)[1:3]
                    a = np.take(a, near - need[k][0], axis=k)
                    reached = np.take(reached, low - need[k][0], axis=k) | np.take(reached, high - need[k][0], axis=k)
                there = a & reached
                continue
            a = a.astype(np.float64) if c in values else a
            for k in range(3):
                inside, low, high, weight = taps(begin[k], end[k], shape[k], factor[k], c in values)
                side = [1, 1, 1]
                side[k] = -1
                take = lambda at: np.take(a, np.clip(at - need[k][0], 0, a.shape[k] - 1), axis=k)  # noqa: B023, E731
                got = take(low)
                if c in values:
                    w = weight.reshape(side)
                    got = got * (1 - w) + take(high) * w
                a = np.where(inside.reshape(side), got, 0)
            result[c] = a
        at = np.nonzero(there)
        out = {c: [v] * len(at[0]) or np.empty(0, dtype=object) for c, v in zip(by, key)} | {a: (at[k] + begin[k]).astype(np.int32) for k, a in enumerate(AXES)}
        return pd.DataFrame(out | {c: (v[at] if c in values else v[at].astype(np.int64)) for c, v in result.items()})

    return packed.mapInPandas(send, slab).groupBy(*by, *cells).applyInPandas(meet, schema)
