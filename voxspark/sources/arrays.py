"""Stored volumes: block tables in Parquet, and array files (.npy) read by byte ranges."""

from __future__ import annotations

import ast
import math
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.blocks import AXES, DTYPES, Blocks, to_blocks
from ..scratch import Scratch

VOXELS = "path string, z int, y int, x int, value double"


def write_volume(voxels: DataFrame, values: Sequence[str], path: str, block: Sequence[int] = (32, 128, 128), mode: str = "errorifexists") -> None:
    """Blocks by volume, sorted by place, so that row groups can be skipped for a crop."""
    blocks = to_blocks(voxels, values, block=block)
    blocks.repartition("volume", "bz").sortWithinPartitions("volume", "bz", "by", "bx").write.mode(mode).partitionBy("volume").parquet(path)


def read_volume(spark: SparkSession, path: str, values: dict[str, str], block: Sequence[int] = (32, 128, 128)) -> Blocks:
    """The blocks written by write_volume, for the operators that work on blocks; values: the types of the arrays, as in a schema."""
    return Blocks(spark.read.parquet(path), {v: DTYPES[k] for v, k in values.items()}, ("volume",), tuple(block))


def explode_blocks(blocks: DataFrame, values: dict[str, str], block: Sequence[int]) -> DataFrame:
    """The voxel view of block rows: no shuffle."""
    kinds = {"double": T.DoubleType(), "bigint": T.LongType(), "float": T.FloatType(), "int": T.IntegerType()}
    schema = T.StructType([T.StructField("volume", T.StringType()), *(T.StructField(a, T.IntegerType()) for a in AXES), *(T.StructField(v, kinds[k]) for v, k in values.items())])

    def run(frames):
        for pdf in frames:
            for row in pdf.to_dict("records"):
                at = np.nonzero(np.frombuffer(row["present"], dtype=bool).reshape(block))
                out = {"volume": row["volume"]} | {a: (i + row[f"b{a}"] * s).astype(np.int32) for a, i, s in zip(AXES, at, block)}
                yield pd.DataFrame(out | {v: np.frombuffer(row[v], dtype=DTYPES[k]).reshape(block)[at] for v, k in values.items()})

    return blocks.select("volume", *(f"b{a}" for a in AXES), "present", *values).mapInPandas(run, schema)


def round_trip_blocks(voxels: DataFrame, values: Sequence[str], block: Sequence[int]) -> DataFrame:
    spark = voxels.sparkSession
    path = Scratch(spark, "volume").path("blocks")
    write_volume(voxels, values, path, block)
    types = dict(voxels.dtypes)
    return explode_blocks(spark.read.parquet(path), {v: types[v] for v in values}, block)


def read_header(file) -> tuple[np.dtype, bool, tuple[int, ...], int]:
    """dtype, Fortran order, shape and the data's position in an array file, from its first bytes."""
    head = file.read_at(12, 0)
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    wide = head[6] >= 2
    size = int.from_bytes(head[8:12] if wide else head[8:10], "little")
    start = 12 if wide else 10
    spec = ast.literal_eval(file.read_at(size, start).decode("latin1"))
    return np.dtype(spec["descr"]), spec["fortran_order"], spec["shape"], start + size


def ingest_volume(spark: SparkSession, paths: DataFrame, slab_bytes: int = 32 << 20, most_tasks: int = 50_000, scratch: Scratch | None = None) -> DataFrame:
    """Voxels (path, z, y, x, value) of 3-D arrays in C order from paths(path): a task reads the byte range of a slab of sections.

    A leading or trailing axis of length one is dropped.
    """

    def plan(frames):
        for pdf in frames:
            for path in pdf["path"]:
                if not path.endswith(".npy"):
                    raise ValueError(f"unknown suffix: {path}")
                where, name = pafs.FileSystem.from_uri(path)
                with where.open_input_file(name) as f:
                    dtype, fortran, shape, start = read_header(f)
                shape = shape[1:] if len(shape) == 4 and shape[0] == 1 else shape[:-1] if len(shape) == 4 and shape[-1] == 1 else shape
                if len(shape) != 3 or fortran:
                    raise ValueError(f"{path} is no 3-D array in C order: {shape}")
                step = max(1, slab_bytes // max(1, math.prod(shape[1:]) * dtype.itemsize))
                yield pd.DataFrame([{"path": path, "dtype": dtype.str, "start": start, "z": z, "n": min(step, shape[0] - z), "h": shape[1], "w": shape[2]} for z in range(0, shape[0], step)])

    slabs = (scratch or Scratch(spark, "ingest")).keep(paths.mapInPandas(plan, "path string, dtype string, start long, z int, n int, h int, w int"), "slabs")
    n = slabs.count()
    # a fixed number, so that the few bytes that name the slabs don't make Spark read all files in one task
    slabs = slabs.repartitionByRange(min(n, most_tasks), "path", "z") if n > 1 else slabs

    def read(frames):
        for pdf in frames:
            for s in pdf.itertuples(index=False):
                where, name = pafs.FileSystem.from_uri(s.path)
                row = s.h * s.w * np.dtype(s.dtype).itemsize
                with where.open_input_file(name) as f:
                    a = np.frombuffer(f.read_at(s.n * row, s.start + s.z * row), dtype=s.dtype).reshape(s.n, s.h, s.w)
                for k in range(s.n):
                    y, x = np.indices((s.h, s.w))
                    yield pd.DataFrame({"path": s.path, "z": s.z + k, "y": y.ravel(), "x": x.ravel(), "value": a[k].ravel().astype(np.float64)})

    return slabs.mapInPandas(read, VOXELS)


def write_sections(voxels: DataFrame, value: str, folder: str) -> DataFrame:
    """One array file a section; (path, z) of those written."""

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import io

        where, path = pafs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        a = np.zeros((1, pdf["y"].max() + 1, pdf["x"].max() + 1))
        a[0, pdf["y"], pdf["x"]] = pdf[value]
        buffer = io.BytesIO()
        np.save(buffer, a)
        name = f"{uuid.uuid4().hex}.npy"
        with where.open_output_stream(f"{path}/{name}") as f:
            f.write(buffer.getvalue())
        return pd.DataFrame([{"path": f"{folder}/{name}", "section": int(key[1])}])

    return voxels.select("volume", "z", "y", "x", value).groupBy("volume", "z").applyInPandas(write, "path string, section int")


def round_trip_arrays(voxels: DataFrame, value: str) -> DataFrame:
    spark = voxels.sparkSession
    scratch = Scratch(spark, "arrays")
    files = scratch.keep(write_sections(voxels, value, scratch.path("sections")), "files")
    return ingest_volume(spark, files.select("path")).join(files, "path").select(F.col("section").alias("z"), "y", "x", F.col("value").alias(value))
