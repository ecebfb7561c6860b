"""Intensity normalisation, thresholds, resolutions: projections over small joined statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..scratch import Scratch
from .prefix import consecutive


def _range(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))


def minmax_norm(df: DataFrame, col: str, by: Sequence[str] = ("volume",)) -> DataFrame:
    """(v - min) / (max - min) per group; untouched where all values are equal."""
    lo, hi = F.col("_lo"), F.col("_hi")
    return df.join(_range(df, by, col), list(by)).withColumn(col, F.when(hi > lo, (F.col(col) - lo) / (hi - lo)).otherwise(F.col(col))).drop("_lo", "_hi")


def probe_params(voxels: DataFrame, volumes: DataFrame, col: str, probe: int = 512) -> DataFrame:
    """(volume, lo, hi) from five sections and their middle window; to be kept as a table."""
    half = probe // 2
    d, h, w = F.col("d"), F.col("h"), F.col("w")
    planes = F.array(F.lit(0), F.floor(d / 4), F.floor(d / 2), F.floor(d * 3 / 4), d - 1)
    middle = lambda a, n: (F.col(a) >= F.floor(n / 2) - half) & (F.col(a) < F.floor(n / 2) + half)
    seen = voxels.join(volumes, "volume").where(F.array_contains(planes.cast("array<int>"), F.col("z")) & middle("y", h) & middle("x", w))
    return seen.groupBy("volume").agg(F.min(col).alias("lo"), F.max(col).alias("hi"))


def apply_norm(voxels: DataFrame, params: DataFrame, col: str) -> DataFrame:
    """Values may leave [0, 1]: the parameters come from a probe."""
    lo, hi = F.col("lo"), F.col("hi")
    return voxels.join(params, "volume").withColumn(col, F.when(hi > lo, (F.col(col) - lo) / (hi - lo)).otherwise(F.col(col))).drop("lo", "hi")


def to_uint8(df: DataFrame, col: str, by: Sequence[str] = ("volume",)) -> DataFrame:
    """0..255, truncated; all 0 if the range is under 1e-8."""
    lo, hi = F.col("_lo"), F.col("_hi")
    u8 = F.when(hi - lo < 1e-8, 0).otherwise(((F.col(col) - lo) / (hi - lo) * 255).cast("int"))
    return df.join(_range(df, by, col), list(by)).withColumn("u8", u8.cast("int")).drop("_lo", "_hi")


def contrast_stretch(df: DataFrame, col: str, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    lo, hi = F.col("_lo"), F.col("_hi")
    return df.join(_range(df, by, col), list(by)).withColumn(col, (F.col(col) - lo) / F.greatest(hi - lo, F.lit(1e-5))).drop("_lo", "_hi")


def rescale_pm1(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col) * 2 - 1


def foreground_ratio(df: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    """Shares of positive and of non-zero labels; they differ for negative ids."""
    return df.groupBy(*by).agg(F.avg((F.col(label) > 0).cast("int")).alias("positive"), F.avg((F.col(label) != 0).cast("int")).alias("nonzero"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def sigmoid_threshold(col: str, threshold: float = 0.5) -> Column:
    return sigmoid(F.col(col)) > threshold


def slice_head(df: DataFrame, channels: str) -> DataFrame:
    """Affinities, semantic logit and raw value of a head of three or more channels."""
    n = F.size(channels)
    df = df.withColumn("_ok", F.when(n < 3, F.raise_error(F.lit("a head needs three channels or more"))).otherwise(True)).where("_ok").drop("_ok")
    return df.withColumns({"aff": F.slice(channels, F.lit(1), F.size(channels) - 2), "sem": F.element_at(channels, -2), "raw": F.element_at(channels, -1)})


def offset_table(spark: SparkSession, offsets: Sequence[Sequence[int]], n_pull: int) -> DataFrame:
    """(off, dz, dy, dx, is_pull, name): names such as 01_pull_z-1."""
    rows = []
    for k, o in enumerate(offsets):
        step = "".join(f"_{a}{d:+d}" for a, d in zip("zyx", o) if d)
        rows.append((k, *map(int, o), k < n_pull, f"{k:02d}_{'pull' if k < n_pull else 'push'}{step}"))
    return spark.createDataFrame(rows, "off int, dz int, dy int, dx int, is_pull boolean, name string")


def native_resolution(volumes: DataFrame, resolution_map: Mapping[str, Sequence[float]], default: Sequence[float]) -> DataFrame:
    """Resolution of the longest prefix of the name in the map, else the default: one expression, no join."""
    out = F.array(*(F.lit(float(v)) for v in default))
    for prefix in sorted(resolution_map, key=lambda p: (len(p), p)):  # longer prefixes override
        out = F.when(F.startswith("volume", F.lit(prefix)), F.array(*(F.lit(float(v)) for v in resolution_map[prefix]))).otherwise(out)
    return volumes.withColumn("_r", out).withColumns({f"r{a}": F.element_at("_r", k + 1) for k, a in enumerate("zyx")}).drop("_r")


def anisotropy(df: DataFrame) -> DataFrame:
    """z over the mean of x and y; xy_only if z is over twice the finer of both."""
    return df.withColumns({"factor": F.col("rz") / ((F.col("rx") + F.col("ry")) / 2), "xy_only": F.col("rz") / F.least("ry", "rx") > 2})


def slice_geometry(volumes: DataFrame) -> DataFrame:
    """Pixel aspect and physical height and width of slices along each axis, from d, h, w and spacings rz, ry, rx."""
    df = volumes.withColumn("axis", F.explode(F.array(*map(F.lit, ("axial", "coronal", "sagittal")))))
    pick = lambda a, c, s: F.when(F.col("axis") == "axial", a).when(F.col("axis") == "coronal", c).otherwise(s)
    z, y, x = F.col("rz"), F.col("ry"), F.col("rx")
    d, h, w = (F.col(n) * r for n, r in (("d", z), ("h", y), ("w", x)))
    return df.select("volume", "axis", pick(y / x, z / x, z / y).alias("aspect"), pick(h, d, d).alias("height"), pick(w, w, h).alias("width"))


def section_entries(voxels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One entry for each section, with a running index over volumes."""
    z = voxels.groupBy("volume", F.col("z").alias("slice_idx")).agg(F.count("*").alias("voxels"))
    ranks = consecutive(z.select(F.struct("volume", "slice_idx").alias("_key")), "_key", scratch or Scratch(voxels.sparkSession, "sections"))
    return z.join(ranks.select("_key.*", (F.col("rank") - 1).alias("idx")), ["volume", "slice_idx"])
