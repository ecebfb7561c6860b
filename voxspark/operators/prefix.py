"""Running totals and ranks over whole tables, without a task that sees all rows.

Rows are dealt to ranges of their order; each range adds up its own rows, and the ranges'
sums, one number a partition, give the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import Scratch


def running_total(rows: DataFrame, order: Sequence[str], weight: str | None, scratch: Scratch, name: str = "before") -> DataFrame:
    """rows with the total weight (null weight: the number) of the rows before each one in a total order."""
    spark = rows.sparkSession
    amount = F.lit(1).cast("long") if weight is None else F.coalesce(F.col(weight).cast("long"), F.lit(0))
    parts = scratch.keep(rows.withColumn("_w", amount).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sums = sorted(parts.groupBy("_p").agg(F.sum("_w").alias("n")).collect())  # one row a partition
    offsets, total = [], 0
    for r in sums:
        offsets.append((r["_p"], total))
        total += r["n"]
    at = F.broadcast(spark.createDataFrame(offsets, "_p int, _offset long"))
    own = F.sum("_w").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("_own", own).join(at, "_p").withColumn(name, F.coalesce("_own", F.lit(0)) + F.col("_offset")).drop("_p", "_w", "_own", "_offset")


def consecutive(ids: DataFrame, column: str, scratch: Scratch) -> DataFrame:
    """(column, rank) of distinct ids, from 1 in order."""
    ranked = running_total(ids.select(column), [column], None, scratch, "rank")
    return ranked.select(column, (F.col("rank") + 1).cast("long").alias("rank"))
