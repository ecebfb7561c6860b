"""Tables that the queries derive from the given ones, and the same in SQL.

A dense labelled volume comes from `embeddings`: z = vec_id div 50, y = vec_id mod 50,
x = the element's index; `gt` and `pr` are two segmentations of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """voxels(volume, z, y, x, val, gt, pr)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v0"))
    z, y = F.floor(F.col("vec_id") / 50), F.col("vec_id") % 50
    v, kind = F.col("v0").cast("double"), e.schema["v0"].dataType
    # SQL compares in the element's own type: the single-precision number next to -0.1 is not below it
    label = lambda low, move: F.when(F.col("v0") < F.lit(low).cast(kind), 0).otherwise(1 + F.floor(z / 5) * 100 + F.floor((y + move) / 10) * 10 + F.floor(F.col("x") / 16)).cast("long")
    return e.select(F.lit("V1").alias("volume"), z.cast("int").alias("z"), y.cast("int").alias("y"), "x", v.alias("val"), label(-0.1, 0).alias("gt"), label(-0.12, 2).alias("pr"))


V1 = """e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS x0, unnest(embedding) AS v0 FROM embeddings),
v AS (SELECT 'V1' AS volume, CAST(vec_id // 50 AS INTEGER) AS z, CAST(vec_id % 50 AS INTEGER) AS y, CAST(x0 AS INTEGER) AS x, CAST(v0 AS DOUBLE) AS val,
  CAST(CASE WHEN v0 < -0.1 THEN 0 ELSE 1 + (vec_id // 50 // 5) * 100 + ((vec_id % 50) // 10) * 10 + x0 // 16 END AS BIGINT) AS gt,
  CAST(CASE WHEN v0 < -0.12 THEN 0 ELSE 1 + (vec_id // 50 // 5) * 100 + (((vec_id % 50) + 2) // 10) * 10 + x0 // 16 END AS BIGINT) AS pr
FROM e)"""


def with_v1(sql: str, *more: str) -> str:
    return f"WITH {', '.join((V1, *more))} {sql}"


def volumes_of(voxels: DataFrame) -> DataFrame:
    """(volume, d, h, w): sizes."""
    return voxels.groupBy("volume").agg((F.max("z") + 1).alias("d"), (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


VOLUMES = "vol AS (SELECT volume, max(z) + 1 AS d, max(y) + 1 AS h, max(x) + 1 AS w FROM v GROUP BY volume)"


def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair of clusterings (sample_id, true, pred) of all rows of lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_linenumber").cast("long").alias("sample_id"), F.col("l_suppkey").cast("long").alias("true"), (F.col("l_partkey") % 37).cast("long").alias("pred"))


L1 = "l AS (SELECT CAST(l_linenumber AS BIGINT) AS sample_id, CAST(l_suppkey AS BIGINT) AS true_, CAST(l_partkey % 37 AS BIGINT) AS pred FROM lineitem)"


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for boxes (name, volume, z, y, x, sz, sy, sx), one for each part."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        F.format_string("c%d", k).alias("name"), F.lit("V1").alias("volume"), (k % 11 - 1).cast("int").alias("z"), (k % 53 - 2).cast("int").alias("y"), (k % 67 - 2).cast("int").alias("x"),
        (1 + k % 4).cast("int").alias("sz"), (1 + k % 9).cast("int").alias("sy"), (1 + k % 13).cast("int").alias("sx"),
    )


CROPS = """crop AS (SELECT 'c' || p_partkey AS name, 'V1' AS volume, CAST(p_partkey % 11 - 1 AS INTEGER) AS z, CAST(p_partkey % 53 - 2 AS INTEGER) AS y, CAST(p_partkey % 67 - 2 AS INTEGER) AS x,
CAST(1 + p_partkey % 4 AS INTEGER) AS sz, CAST(1 + p_partkey % 9 AS INTEGER) AS sy, CAST(1 + p_partkey % 13 AS INTEGER) AS sx FROM part)"""


def draw_sql(*parts) -> str:
    """The number in [0, 1) that tiling.uniform draws from these parts."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(map(str, parts))})), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


def start_sql(size, patch, seed, axis, *keys) -> str:
    """The place that tiling.random_start draws."""
    return f"CAST(floor({draw_sql(seed, axis, *keys)} * (greatest({size} - {patch}, 0) + 1)) AS INTEGER)"
