"""Dense blocks of voxels, and functions of a block with a rim of its neighbours.

A block row holds an array for each value of the voxels in one cell of a grid.  Voxel
rows are packed where they are read, and only packed parts of blocks move; blocks that are
stored (see ``sources.arrays``) don't move at all.  ``halo_apply`` sends each block to
itself and, of it, only the overlapping slab to each neighbour: one shuffle of slabs
serves all offsets, whatever their number.  Voxel rows go to all blocks that see them as they are
packed, so that no batch of whole blocks is held.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..scratch import Scratch
from .prefix import running_total

AXES = ("z", "y", "x")
DTYPES = {"double": "f8", "float": "f4", "bigint": "i8", "int": "i4", "smallint": "i2", "tinyint": "i1", "boolean": "?"}
NAMES = {"f8": T.DoubleType(), "f4": T.FloatType(), "i8": T.LongType(), "i4": T.IntegerType(), "i2": T.ShortType(), "i1": T.ByteType(), "?": T.BooleanType()}


@dataclass
class Region:
    """A block with its rim, cut to the volume: arrays by name, where voxels exist, and places."""

    keys: tuple
    arrays: dict[str, np.ndarray]
    present: np.ndarray
    origin: np.ndarray  # of the region in the volume
    shape: np.ndarray  # of the volume
    base: int  # id of the volume's first voxel
    core: tuple[slice, slice, slice]

    def ids(self) -> np.ndarray:
        """Flat voxel ids over the region."""
        z, y, x = np.indices(self.present.shape)
        o, s = self.origin, self.shape
        return self.base + ((z + o[0]) * s[1] + (y + o[1])) * s[2] + (x + o[2])

    def shifted(self, a: np.ndarray, offset: Sequence[int]) -> np.ndarray:
        """a at each core voxel moved by the offset, clamped to the volume."""
        index = []
        for k, d in enumerate(offset):
            at = np.arange(self.core[k].start, self.core[k].stop) + self.origin[k] + d
            index.append(np.clip(at, 0, self.shape[k] - 1) - self.origin[k])
        return a[np.ix_(*index)]

    def rows(self, by: Sequence[str], there: np.ndarray | None = None, /, **values: np.ndarray) -> pd.DataFrame:
        """Core voxels, those of `there` or else the present ones, with values; a value with a leading axis becomes an array."""
        at = np.nonzero(self.present[self.core] if there is None else there)
        out = {c: [v] * len(at[0]) or np.empty(0, dtype=object) for c, v in zip(by, self.keys)}  # an empty list would be of floats
        out |= {a: (at[k] + self.origin[k] + self.core[k].start).astype(np.int32) for k, a in enumerate(AXES)}
        for name, v in values.items():
            out[name] = v[at] if v.ndim == 3 else list(np.ascontiguousarray(v[(slice(None), *at)].T))
        return pd.DataFrame(out)


@dataclass(frozen=True)
class Blocks:
    """Block rows as a table, to be given in place of voxel rows.

    df holds, for each block, its volume's columns `by`, bz, by, bx, present and the values as
    arrays in C order, and the volume's sizes d, h, w; kinds are the values' types in the arrays.
    """

    df: DataFrame
    kinds: dict[str, str]
    by: tuple[str, ...] = ("volume",)
    block: tuple[int, ...] = (32, 128, 128)

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    @property
    def sparkSession(self):
        return self.df.sparkSession


def volume_shapes(voxels: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, d, h, w): sizes of the volumes."""
    return voxels.groupBy(*by).agg(*((F.max(a) + 1).cast("long").alias(n) for a, n in zip(AXES, ("d", "h", "w"))))


def _some_rows(pack: Callable[[pd.DataFrame], pd.DataFrame], rows: int):
    """pack of a task's voxels, about `rows` at a time."""

    def run(frames):
        held, n = [], 0
        for pdf in frames:
            held.append(pdf)
            n += len(pdf)
            if n >= rows:
                yield pack(pd.concat(held, ignore_index=True))
                held, n = [], 0
        if n:
            yield pack(pd.concat(held, ignore_index=True))

    return run


def to_blocks(voxels: DataFrame, values: Sequence[str], by: Sequence[str] = ("volume",), block: Sequence[int] = (32, 128, 128), rows: int = 1 << 19) -> DataFrame:
    """Block rows: by, bz, by_, bx, the values' arrays in C order, present, and the volume's sizes.

    Each task packs its voxels, up to `rows` at a time, into parts of blocks; the parts are merged by block.
    """
    kinds = {v: DTYPES[dict(voxels.dtypes)[v]] for v in values}
    cells = [f"b{a}" for a in AXES]
    keys = [voxels.schema[c] for c in by] + [T.StructField(c, T.IntegerType()) for c in cells]
    binary = lambda *names: [T.StructField(c, T.BinaryType()) for c in names]
    part = T.StructType([*keys, *binary("at", *values)])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        place = [pdf[a].to_numpy(dtype=np.int64) for a in AXES]
        flat = np.zeros(len(pdf), dtype=np.int64)
        for k, b in enumerate(block):
            pdf[cells[k]] = (place[k] // b).astype(np.int32)
            flat = flat * b + place[k] % b
        out = []
        for key, index in pdf.groupby([*by, *cells], sort=False, dropna=False).indices.items():
            row = {c: None if pd.isna(v) else v for c, v in zip([*by, *cells], key)}
            out.append(row | {"at": flat[index].astype(np.int32).tobytes()} | {v: pdf[v].to_numpy()[index].astype(k).tobytes() for v, k in kinds.items()})
        return pd.DataFrame(out)[part.names]

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row = dict(zip([*by, *cells], key))
        arrays = {"present": np.zeros(math.prod(block), dtype=bool)} | {v: np.zeros(math.prod(block), dtype=k) for v, k in kinds.items()}
        for r in pdf.to_dict("records"):
            at = np.frombuffer(r["at"], dtype=np.int32)
            arrays["present"][at] = True
            for v, k in kinds.items():
                arrays[v][at] = np.frombuffer(r[v], dtype=k)
        return pd.DataFrame([row | {c: a.tobytes() for c, a in arrays.items()}])

    packed = voxels.select(*by, *AXES, *values).mapInPandas(_some_rows(pack, rows), part).groupBy(*by, *cells).applyInPandas(merge, T.StructType([*keys, *binary("present", *values)]))
    shapes = F.broadcast(volume_shapes(voxels, by).select(*(F.col(c).alias(f"_{c}") for c in by), "d", "h", "w"))  # one row a volume
    same = [packed[c].eqNullSafe(shapes[f"_{c}"]) for c in by]
    return packed.join(shapes, same).drop(*(f"_{c}" for c in by)) if by else packed.crossJoin(shapes)


def block_rows(voxels: DataFrame | Blocks, values: Sequence[str], by: Sequence[str], block: Sequence[int]) -> tuple[DataFrame, dict[str, str]]:
    """Block rows of voxels, or the blocks themselves if they are cut alike; and the values' types."""
    if isinstance(voxels, Blocks):
        if tuple(voxels.block) != tuple(block) or tuple(voxels.by) != tuple(by):
            raise ValueError(f"the blocks are {voxels.block} by {voxels.by}")
        return voxels.df.select(*by, *(f"b{a}" for a in AXES), "present", *values, "d", "h", "w"), {v: voxels.kinds[v] for v in values}
    return to_blocks(voxels, values, by, block), {v: DTYPES[dict(voxels.dtypes)[v]] for v in values}


def with_bases(blocks: DataFrame, shapes: DataFrame, by: Sequence[str], scratch: Scratch) -> DataFrame:
    """blocks with base, the id of their volume's first voxel, when all volumes' voxels are numbered in a row."""
    n = shapes.select(*by, (F.col("d").cast("long") * F.col("h") * F.col("w")).alias("_n")) if by else shapes.limit(0)
    if not by:
        return blocks.withColumn("base", F.lit(0).cast("long"))
    base = running_total(n, list(by), "_n", scratch, "base").select(*(F.col(c).alias(f"_{c}") for c in by), "base")
    return blocks.join(base, [blocks[c].eqNullSafe(base[f"_{c}"]) for c in by]).drop(*(f"_{c}" for c in by))


def _voxel_slabs(voxels: DataFrame, kinds: dict[str, str], halo: Sequence[int], by: Sequence[str], block: Sequence[int], numbered: Scratch | None, rows: int = 1 << 17) -> DataFrame:
    """Slabs of voxel rows: for each block that sees voxels of a task, where they lie in the block with its rim, and their values."""
    cells, reach = [f"b{a}" for a in AXES], [-(-h // b) for h, b in zip(halo, block)]
    room = [b + 2 * h for b, h in zip(block, halo)]
    slab = T.StructType([voxels.schema[c] for c in by] + [T.StructField(c, T.IntegerType()) for c in cells] + [T.StructField(c, T.BinaryType()) for c in ("at", *kinds)])

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        place = np.stack([pdf[a].to_numpy(dtype=np.int64) for a in AXES])
        values = {c: pdf[c].to_numpy().astype(k) for c, k in kinds.items()}
        groups = pdf.groupby(list(by), sort=False, dropna=False).indices if by else {(): np.arange(len(pdf))}
        own, out = place // np.array(block)[:, None], []
        # of each axis, by the step to a block: which voxels lie in its reach
        sees = [{s: (own[k] + s >= 0) & (place[k] >= (own[k] + s) * b - h) & (place[k] < (own[k] + s + 1) * b + h) for s in range(-r, r + 1)} for k, (b, h, r) in enumerate(zip(block, halo, reach))]
        for key, of in groups.items():
            row = {c: None if pd.isna(v) else v for c, v in zip(by, key if isinstance(key, tuple) else (key,))}
            for step in product(*(range(-r, r + 1) for r in reach)):
                index = of[sees[0][step[0]][of] & sees[1][step[1]][of] & sees[2][step[2]][of]]
                if not len(index):
                    continue
                to = own[:, index] + np.array(step)[:, None]
                low = to.min(axis=1)
                cell = np.ravel_multi_index(to - low[:, None], to.max(axis=1) - low + 1)
                order = np.argsort(cell, kind="stable")
                index, to = index[order], to[:, order]
                at = np.ravel_multi_index(place[:, index] - (to * np.array(block)[:, None] - np.array(halo)[:, None]), room).astype(np.int32)
                cut = np.append(np.flatnonzero(np.diff(cell[order], prepend=-1)), len(index))
                for i, j in zip(cut[:-1], cut[1:]):
                    out.append(row | dict(zip(cells, to[:, i].tolist())) | {"at": at[i:j].tobytes()} | {c: v[index[i:j]].tobytes() for c, v in values.items()})
        return pd.DataFrame(out)[slab.names]

    shapes = volume_shapes(voxels, by)
    shapes = F.broadcast(shapes.withColumn("base", F.lit(0).cast("long")) if numbered is None else with_bases(shapes, shapes, by, numbered))  # one row a volume
    shapes = shapes.select(*(F.col(c).alias(f"_{c}") for c in by), "d", "h", "w", "base")
    sent = voxels.select(*by, *AXES, *kinds).mapInPandas(_some_rows(send, rows), slab)
    sized = sent.join(shapes, [sent[c].eqNullSafe(shapes[f"_{c}"]) for c in by]).drop(*(f"_{c}" for c in by)) if by else sent.crossJoin(shapes)
    inside = [F.col(c) * b < F.col(n) for c, b, n in zip(cells, block, ("d", "h", "w"))]
    return sized.where(inside[0] & inside[1] & inside[2])


def _block_slabs(blocks: DataFrame, kinds: dict[str, str], halo: Sequence[int], by: Sequence[str], block: Sequence[int]) -> DataFrame:
    """Slabs of block rows: for each block that sees a part of one, its box in the volume, and the values there."""
    cells, reach = [f"b{a}" for a in AXES], [-(-h // b) for h, b in zip(halo, block)]
    slab = T.StructType([blocks.schema[c] for c in by] + [T.StructField(c, T.IntegerType()) for c in cells] + [T.StructField(c, T.LongType()) for c in ("d", "h", "w", "base")] + [T.StructField("part", T.ArrayType(T.IntegerType()))] + [T.StructField(c, T.BinaryType()) for c in kinds])
    most = 4 << 20  # bytes of slabs given out at a time

    def send(frames):
        for pdf in frames:
            out, held = [], 0
            for row in pdf.to_dict("records"):
                size = [row[n] for n in ("d", "h", "w")]
                own = [row[c] for c in cells]
                for step in product(*(range(-r, r + 1) for r in reach)):
                    to = [o + s for o, s in zip(own, step)]
                    lo = [max(o * b, t * b - h, 0) for o, t, b, h in zip(own, to, block, halo)]
                    hi = [min((o + 1) * b, (t + 1) * b + h, n) for o, t, b, h, n in zip(own, to, block, halo, size)]
                    if any(i >= j for i, j in zip(lo, hi)) or any(t < 0 or t * b >= n for t, b, n in zip(to, block, size)):
                        continue
                    cut = tuple(slice(i - o * b, j - o * b) for i, j, o, b in zip(lo, hi, own, block))
                    part = {c: np.frombuffer(row[c], dtype=k).reshape(block)[cut].tobytes() for c, k in kinds.items()}
                    out.append({c: row[c] for c in (*by, "d", "h", "w", "base")} | dict(zip(cells, to)) | {"part": [*lo, *hi]} | part)
                    held += sum(map(len, part.values()))
                if held >= most:  # a batch of blocks makes many slabs
                    yield pd.DataFrame(out)[slab.names]
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out)[slab.names]

    return blocks.mapInPandas(send, slab)


def halo_apply(voxels: DataFrame | Blocks, values: Sequence[str], halo: Sequence[int], fn: Callable[[Region], pd.DataFrame], schema: str | T.StructType, by: Sequence[str] = ("volume",), block: Sequence[int] = (32, 128, 128), numbered: Scratch | None = None) -> DataFrame:
    """fn of each block with a rim of `halo` voxels on both sides of each axis; with `numbered`, voxel ids differ between volumes too."""
    stored = isinstance(voxels, Blocks)
    if stored:
        blocks, kinds = block_rows(voxels, values, by, block)
        kinds = {"present": "?", **kinds}
        shapes = voxels.df.select(*by, "d", "h", "w").distinct()
        slabs = _block_slabs(blocks.withColumn("base", F.lit(0).cast("long")) if numbered is None else with_bases(blocks, shapes, by, numbered), kinds, halo, by, block)
    else:
        kinds = {v: DTYPES[dict(voxels.dtypes)[v]] for v in values}
        slabs = _voxel_slabs(voxels, kinds, halo, by, block, numbered)
        kinds = {"present": "?", **kinds}

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cell, first = key[-3:], pdf.iloc[0]
        shape = np.array([first["d"], first["h"], first["w"]])
        lo = np.array([max(0, c * b - h) for c, b, h in zip(cell, block, halo)])
        hi = np.array([min(n, (c + 1) * b + h) for c, b, h, n in zip(cell, block, halo, shape)])
        arrays = {c: np.zeros(hi - lo, dtype=k) for c, k in kinds.items()}
        for row in pdf.to_dict("records"):
            if stored:
                a, b = np.array(row["part"][:3]), np.array(row["part"][3:])
                at = tuple(slice(i, j) for i, j in zip(a - lo, b - lo))
            else:
                place = np.unravel_index(np.frombuffer(row["at"], dtype=np.int32), [b + 2 * h for b, h in zip(block, halo)])
                at = tuple(p + int(c * b - h - l) for p, c, b, h, l in zip(place, cell, block, halo, lo))
            for c, k in kinds.items():
                arrays[c][at] = True if c == "present" and not stored else np.frombuffer(row[c], dtype=k).reshape(b - a if stored else -1)
        core = tuple(slice(int(c * b - l), int(min((c + 1) * b, n) - l)) for c, b, l, n in zip(cell, block, lo, shape))
        return fn(Region(key[:-3], arrays, arrays.pop("present"), lo, shape, int(first["base"]), core))

    return slabs.groupBy(*by, *(f"b{a}" for a in AXES)).applyInPandas(meet, schema)


def voxel_schema(voxels: DataFrame | Blocks, by: Sequence[str], **columns: T.DataType) -> T.StructType:
    return T.StructType([voxels.schema[c] for c in by] + [T.StructField(a, T.IntegerType()) for a in AXES] + [T.StructField(c, k) for c, k in columns.items()])
