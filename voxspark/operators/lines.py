"""Nearest sources along the axes of volumes: exact Euclidean transforms on packed lines.

A voxel's nearest source is found axis by axis.  Along x a voxel takes the nearest source of
its line; along y it takes, of its line's voxels, the one whose source is nearest; and so
along z.  Each pass is the lower envelope of one parabola a voxel, for all lines of a
tile at once.  Of equal distances the lower coordinate wins in each pass, which makes the
source the first by (z, y, x) among the nearest.

Volumes move as tiles of whole lines in packed arrays: one exchange for each axis.  The
number of lines in a tile follows from their length, so that a task's memory grows with a
single line only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .blocks import AXES, Blocks, block_rows

SIZES = ("d", "h", "w")
TILE_VOXELS = 1 << 20
TILE_EDGE = 128


def envelope(cost: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each line (row): min over j of cost[j] + (step * (i - j))**2 and the smallest such j; -1 where no cost is finite."""
    n, size = cost.shape
    finite, square = np.isfinite(cost), step * step
    stack, since = np.zeros((n, size), dtype=np.int64), np.full((n, size), np.inf)  # the parabolas, and from where on each is the lowest
    top = np.full(n, -1)
    for j in np.flatnonzero(finite.any(axis=0)).tolist():
        live = np.flatnonzero(finite[:, j])
        cross, todo = np.full(len(live), -np.inf), np.arange(len(live))
        while len(todo):
            todo = todo[top[live[todo]] >= 0]
            r = live[todo]
            k = top[r]
            v = stack[r, k]
            c = (cost[r, j] - cost[r, v] + square * (j * j - v * v)) / (2 * square * (j - v))
            under = c <= since[r, k]
            cross[todo[~under]] = c[~under]
            top[r[under]] -= 1
            todo = todo[under]
        top[live] += 1
        stack[live, top[live]], since[live, top[live]] = j, cross
    # the parabola of place i is the last one whose range begins before i
    line, k = np.nonzero((np.arange(size) <= top[:, None]) & (np.arange(size) > 0))
    begin = np.clip(np.floor(since[line, k]) + 1, 0, size).astype(np.int64)
    at = np.bincount(line * (size + 1) + begin, minlength=n * (size + 1)).reshape(n, size + 1).cumsum(axis=1)[:, :size]
    place, last = np.arange(size), np.maximum(top, 0)[:, None]
    best, source = np.full(cost.shape, np.inf), np.full(cost.shape, -1)
    for move in (-1, 0, 1):  # neighbours too, for rounding where two meet
        j = np.take_along_axis(stack, np.clip(at + move, 0, last), axis=1)
        now = np.take_along_axis(cost, j, axis=1) + square * (place - j) ** 2
        lower = now < best
        best[lower], source[lower] = now[lower], j[lower]
    none = top < 0
    best[none], source[none] = np.inf, -1
    return best, source


def along(axis: int, cost: np.ndarray, carried: np.ndarray | None, step: float) -> tuple[np.ndarray, np.ndarray | None]:
    """One pass over a 3-D array; carried values come from each voxel's source."""
    turned = np.moveaxis(cost, axis, 2)
    best, source = envelope(turned.reshape(-1, turned.shape[2]), step)
    if carried is not None:
        lines = np.moveaxis(carried, axis, 2).reshape(-1, turned.shape[2])
        got = np.where(source >= 0, np.take_along_axis(lines, np.maximum(source, 0), axis=1), 0)
        carried = np.moveaxis(got.reshape(turned.shape), 2, axis)
    return np.moveaxis(best.reshape(turned.shape), 2, axis), carried


def nearest_labels(labels: np.ndarray, sampling: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance to the nearest label above or below 0, and that label, within one array."""
    cost, carried = np.where(labels != 0, 0.0, np.inf), labels
    for axis in (2, 1, 0):
        cost, carried = along(axis, cost, carried, sampling[axis])
    return cost, carried


def _edge(length: int) -> int:
    return max(1, min(TILE_EDGE, math.isqrt(TILE_VOXELS // max(1, length))))


def _others(axis: int) -> tuple[int, int]:
    return tuple(k for k in range(3) if k != axis)


def _pieces(axis: int, lo: Sequence[int], arrays: dict[str, np.ndarray], shape: Sequence[int]) -> Iterator[dict]:
    """A box of the volume, cut for the tiles of lines along an axis."""
    a, b = _others(axis)
    edge, size = _edge(shape[axis]), next(iter(arrays.values())).shape
    for ca in range(lo[a] // edge, (lo[a] + size[a] - 1) // edge + 1):
        for cb in range(lo[b] // edge, (lo[b] + size[b] - 1) // edge + 1):
            begin, end = list(lo), [i + s for i, s in zip(lo, size)]
            for k, c in ((a, ca), (b, cb)):
                begin[k], end[k] = max(begin[k], c * edge), min(end[k], (c + 1) * edge)
            cut = tuple(slice(i - o, j - o) for i, j, o in zip(begin, end, lo))
            yield {"ca": ca, "cb": cb, "part": [*begin, *end]} | {name: np.ascontiguousarray(v[cut]).tobytes() for name, v in arrays.items()}


def nearest(voxels: DataFrame | Blocks, source: str, sampling: Sequence[float] = (1.0, 1.0, 1.0), carry: bool = False, by: Sequence[str] = ("volume",), block: Sequence[int] = (32, 128, 128)) -> DataFrame:
    """(by, z, y, x, squared[, carried]): squared distance to the nearest voxel whose column `source` is not 0 (or is true), and that value.

    Infinite (carried: 0) in volumes without one.
    """
    packed, kinds = block_rows(voxels, [source], by, block)
    names = {"present": "?", "q": "f8"} | ({"carried": "i8"} if carry else {})
    piece = T.StructType(
        [packed.schema[c] for c in by] + [T.StructField(c, T.IntegerType()) for c in ("ca", "cb")] + [T.StructField(c, T.LongType()) for c in SIZES]
        + [T.StructField("part", T.ArrayType(T.IntegerType()))] + [T.StructField(c, T.BinaryType()) for c in names]
    )

    def first(frames):
        for pdf in frames:
            for row in pdf.to_dict("records"):
                shape = [int(row[n]) for n in SIZES]
                lo = [row[f"b{a}"] * b for a, b in zip(AXES, block)]
                cut = tuple(slice(0, min(b, n - i)) for b, n, i in zip(block, shape, lo))
                present = np.frombuffer(row["present"], dtype="?").reshape(block)[cut]
                value = np.frombuffer(row[source], dtype=kinds[source]).reshape(block)[cut]
                arrays = {"present": present, "q": np.where(present & (value != 0), 0.0, np.inf)} | ({"carried": value.astype(np.int64)} if carry else {})
                out = [{c: row[c] for c in (*by, *SIZES)} | p for p in _pieces(2, lo, arrays, shape)]
                yield pd.DataFrame(out)[piece.names]

    def meet(axis: int):
        a, b = _others(axis)

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            shape = [int(pdf[n].iloc[0]) for n in SIZES]
            edge, lo, hi = _edge(shape[axis]), [0, 0, 0], list(shape)
            for k, c in ((a, key[-2]), (b, key[-1])):
                lo[k], hi[k] = c * edge, min((c + 1) * edge, shape[k])
            size = [j - i for i, j in zip(lo, hi)]
            arrays = {c: np.full(size, np.inf if c == "q" else 0, dtype=k) for c, k in names.items()}
            for row in pdf.to_dict("records"):
                begin, end = row["part"][:3], row["part"][3:]
                at = tuple(slice(i - o, j - o) for i, j, o in zip(begin, end, lo))
                for c, k in names.items():
                    arrays[c][at] = np.frombuffer(row[c], dtype=k).reshape([j - i for i, j in zip(begin, end)])
            arrays["q"], carried = along(axis, arrays["q"], arrays.get("carried"), sampling[axis])
            if carry:
                arrays["carried"] = carried
            if axis:
                out = pd.DataFrame(list(_pieces(axis - 1, lo, arrays, shape)))
                return out.assign(**dict(zip([*by, *SIZES], [*key[:-2], *shape])))[piece.names]
            at = np.nonzero(arrays["present"])
            out = {c: [v] * len(at[0]) for c, v in zip(by, key)} | {n: (i + o).astype(np.int32) for n, i, o in zip(AXES, at, lo)}
            return pd.DataFrame(out | {"squared": arrays["q"][at]} | ({"carried": arrays["carried"][at]} if carry else {}))

        return run

    last = T.StructType(
        [packed.schema[c] for c in by] + [T.StructField(a, T.IntegerType()) for a in AXES] + [T.StructField("squared", T.DoubleType())]
        + ([T.StructField("carried", T.LongType())] if carry else [])
    )
    cur = packed.mapInPandas(first, piece)
    for axis in (2, 1, 0):
        cur = cur.groupBy(*by, "ca", "cb").applyInPandas(meet(axis), piece if axis else last)
    return cur


def edt(df: DataFrame, mask: str, sampling: Sequence[float] = (1.0, 1.0, 1.0), by: Sequence[str] = ("volume",), block: Sequence[int] = (32, 128, 128)) -> DataFrame:
    """(by, z, y, x, distance) to the nearest zero of the mask: exact; infinite in a volume without any zero."""
    zero = df.select(*by, *AXES, (~F.coalesce(F.col(mask).cast("boolean"), F.lit(False))).alias("_zero"))
    return nearest(zero, "_zero", sampling, by=by, block=block).select(*by, *AXES, F.sqrt("squared").alias("distance"))
