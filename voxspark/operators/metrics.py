"""Segmentation metrics from one sparse contingency table.

All instance metrics follow from sums over the cells (true, pred) and over the two
marginals, so one shuffle of partial counts serves them all, and no cell has to be
joined to its marginals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..scratch import Scratch


def prepare_labels(df: DataFrame, ignore_background: bool = True) -> DataFrame:
    """Voxels where either side has a label; 0 stays a class of its own on the other side."""
    return df.where((F.col("true") > 0) | (F.col("pred") > 0)) if ignore_background else df


def contingency(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, "true", "pred").agg(F.count("*").alias("n"))


def cluster_sums(df: DataFrame, by: Sequence[str] = (), ignore_background: bool = True) -> DataFrame:
    """Per group: n, cells, n_true, n_pred and the sums of squares and of n ln n of cells and marginals."""
    return _sums(contingency(df, by), by, ignore_background)


def _sums(counts: DataFrame, by: Sequence[str], ignore_background: bool) -> DataFrame:
    """cluster_sums of a contingency table, the cell of (0, 0) included."""
    keys = [*by, "_k"]
    cells = prepare_labels(counts, ignore_background).withColumn("_k", F.lit(0))

    def sums(counts: DataFrame, name: str) -> DataFrame:
        n = F.col("n").cast("double")
        return counts.groupBy(*keys).agg(F.sum("n").alias(f"n_{name}"), F.count("*").alias(f"k_{name}"), F.sum(n * n).alias(f"sq_{name}"), F.sum(n * F.log(n)).alias(f"ln_{name}"))

    margin = lambda c: cells.groupBy(*keys, c).agg(F.sum("n").alias("n"))
    out = sums(cells, "cell").join(sums(margin("true"), "true"), keys).join(sums(margin("pred"), "pred"), keys)
    out = out.withColumnRenamed("n_cell", "n").drop("n_true", "n_pred", "_k")
    if by:  # groups without any labelled voxel
        return counts.select(*by).distinct().join(out, list(by), "left").fillna(0)
    empty = counts.sparkSession.range(1).select(F.lit(0).alias("_z"))
    return empty.join(out, F.lit(True), "left").drop("_z").fillna(0)


def _or_zero(value: Column) -> Column:
    return F.when(F.col("n") > 0, value).otherwise(0.0)


def _ari() -> Column:
    n = F.col("n").cast("double")
    tp, fp, fn = F.col("sq_cell") - n, F.col("sq_pred") - F.col("sq_cell"), F.col("sq_true") - F.col("sq_cell")
    tn = n * n - n - tp - fp - fn
    value = F.when((fp == 0) & (fn == 0), 1.0).otherwise(2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))
    return F.greatest(_or_zero(value), F.lit(0.0)).alias("ari")


def _voi() -> list[Column]:
    bits = lambda name: _or_zero((F.col(f"ln_{name}") - F.col("ln_cell")) / F.col("n") / math.log(2))
    return [bits("true").alias("voi_split"), bits("pred").alias("voi_merge"), (bits("true") + bits("pred")).alias("voi")]


def _ted() -> Column:
    return (2 * F.col("k_cell") - F.col("k_true") - F.col("k_pred")).cast("long").alias("ted")


def ari(df: DataFrame, by: Sequence[str] = (), ignore_background: bool = True) -> DataFrame:
    """Adjusted Rand index, at least 0; 0 without voxels, 1 without disagreement."""
    return cluster_sums(df, by, ignore_background).select(*by, _ari())


def voi(df: DataFrame, by: Sequence[str] = (), ignore_background: bool = True) -> DataFrame:
    """Variation of information in bits: split H(pred|true), merge H(true|pred) and their sum."""
    return cluster_sums(df, by, ignore_background).select(*by, *_voi())


def ted(df: DataFrame, by: Sequence[str] = (), ignore_background: bool = True) -> DataFrame:
    """Splits and merges: partners beyond the first, over all true and all predicted ids."""
    return cluster_sums(df, by, ignore_background).select(*by, _ted())


_SMALL = np.array([math.lgamma(k + 1) for k in range(12)])


def ln_factorial(n: np.ndarray) -> np.ndarray:
    """ln n! by Stirling's series; small n from a list."""
    x = np.maximum(n, 1.0)
    series = x * np.log(x) - x + 0.5 * np.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 12, _SMALL[np.clip(n, 0, 11).astype(np.int64)], series)


def expected_information(a: np.ndarray, b: np.ndarray, n: np.ndarray, first: np.ndarray, last: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """For each pair of cluster sizes a, b among n voxels, its part of the expected mutual information, summed over overlaps first..last, about `most` at a time."""
    a, b, n, first = (v.astype(np.float64) for v in (a, b, n, first))
    count = np.maximum(last - first + 1, 0).astype(np.int64)
    whole = sum(map(ln_factorial, (a, b, n - a, n - b))) - ln_factorial(n)
    out, upto, start = np.zeros(len(a)), np.cumsum(count), 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(upto, upto[start] - count[start] + most, side="right")))
        part = slice(start, stop)
        i = np.repeat(np.arange(stop - start), count[part])
        ia, ib, in_ = a[part][i], b[part][i], n[part][i]
        k = first[part][i] + np.arange(len(i)) - (upto[part] - count[part] - (upto[start] - count[start]))[i]
        log_p = whole[part][i] - ln_factorial(k) - ln_factorial(ia - k) - ln_factorial(ib - k) - ln_factorial(in_ - ia - ib + k)
        out[part] = np.bincount(i, k / in_ * np.log(in_ * k / (ia * ib)) * np.exp(log_p), stop - start)
        start = stop
    return out


def _ami(counts: DataFrame, by: Sequence[str], ignore_background: bool, sums: DataFrame) -> DataFrame:
    """sums with the expected mutual information `emi` of a contingency table."""
    keys = [*by, "_k"]
    cells = prepare_labels(counts, ignore_background).withColumn("_k", F.lit(0))
    total = cells.groupBy(*keys).agg(F.sum("n").alias("N"))
    sizes = lambda c, s, m: cells.groupBy(*keys, c).agg(F.sum("n").alias(s)).groupBy(*keys, s).agg(F.count("*").alias(m))
    pairs = sizes("true", "a", "ma").join(sizes("pred", "b", "mb"), keys).join(total, keys)
    a, b, n = F.col("a"), F.col("b"), F.col("N")
    mean = a.cast("double") * b / n
    reach = 9 * F.sqrt(F.least(mean * (1 - b / n), mean * (1 - a / n))) + 30
    first = F.greatest(F.lit(1).cast("long"), a + b - n, F.floor(mean - reach).cast("long"))
    last = F.least(a, b, F.ceil(mean + reach).cast("long"))
    pairs = pairs.select(*keys, "a", "b", "N", (F.col("ma") * F.col("mb")).alias("times"), first.alias("first"), last.alias("last"))
    # a pair is a few bytes and thousands of terms: without a number of parts, Spark would put all pairs in one task
    dealt = pairs.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "a", "b")

    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            part = expected_information(*(pdf[c].to_numpy() for c in ("a", "b", "N", "first", "last")))
            yield pdf[keys].assign(part=pdf["times"].to_numpy() * part)

    parts = dealt.mapInPandas(add_up, T.StructType([*(pairs.schema[c] for c in keys), T.StructField("part", T.DoubleType())]))
    emi = parts.groupBy(*keys).agg(F.sum("part").alias("emi")).drop("_k")
    return sums.join(emi, list(by), "left") if by else sums.join(emi, F.lit(True), "left")


def _adjusted() -> Column:
    ln_n = F.log(F.col("n").cast("double"))
    h = lambda name: ln_n - F.col(f"ln_{name}") / F.col("n")
    mi = (F.col("ln_cell") - F.col("ln_true") - F.col("ln_pred")) / F.col("n") + ln_n
    bound = (h("true") + h("pred")) / 2 - F.col("emi")
    bound = F.when(bound < 0, F.least(bound, F.lit(-2.3e-16))).otherwise(F.greatest(bound, F.lit(2.3e-16)))
    value = F.when(((F.col("k_true") == 1) & (F.col("k_pred") == 1)) | ((F.col("k_true") == F.col("k_cell")) & (F.col("k_pred") == F.col("k_cell"))), 1.0).otherwise((mi - F.col("emi")) / bound)
    return F.greatest(_or_zero(value), F.lit(0.0)).alias("ami")


def ami(df: DataFrame, by: Sequence[str] = (), ignore_background: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """Adjusted mutual information (mean of the entropies), at least 0.

    The expected mutual information is summed over pairs of different cluster sizes
    with their multiplicities.  Of a pair's terms only those within nine standard
    deviations and 30 of the mean are taken, so their number grows with the square root of
    the smaller size: by Bernstein's bound, which holds for draws without replacement too, the others have a chance of
    at most 2 exp(-40), and each is at most ln n.
    """
    counts = (scratch or Scratch(df.sparkSession, "ami")).keep(contingency(df, by), "counts")
    return _ami(counts, by, ignore_background, _sums(counts, by, ignore_background)).select(*by, _adjusted())


def batch_mean(per_sample: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Means over samples; the mean VOI is the sum of its two means."""
    out = per_sample.agg(*(F.avg(c).alias(c) for c in columns))
    return out.withColumn("voi", F.col("voi_split") + F.col("voi_merge")) if "voi_split" in columns else out


def _class_sums(df: DataFrame, by: Sequence[str], num_classes: int, ignore_index: int) -> DataFrame:
    seen = df.where((F.col("true") != ignore_index) & (F.col("pred") != ignore_index))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = [f.alias(f"{name}{c}") for c in range(num_classes) for name, f in (("i", one((F.col("true") == c) & (F.col("pred") == c))), ("t", one(F.col("true") == c)), ("p", one(F.col("pred") == c)))]
    return seen.groupBy(*by).agg(*sums)


def _mean(values: Sequence[Column]) -> Column:
    known = [F.when(v.isNotNull(), 1).otherwise(0) for v in values]
    return F.coalesce(reduce(lambda a, b: a + b, (F.coalesce(v, F.lit(0.0)) for v in values)) / F.nullif(reduce(lambda a, b: a + b, known), F.lit(0)), F.lit(0.0))


def dice(df: DataFrame, by: Sequence[str] = (), num_classes: int = 2, ignore_index: int = -100) -> DataFrame:
    """Mean over all classes, background too; a class absent on both sides counts 1."""
    value = [F.when(F.col(f"t{c}") + F.col(f"p{c}") > 0, 2 * F.col(f"i{c}") / (F.col(f"t{c}") + F.col(f"p{c}"))).otherwise(1.0) for c in range(num_classes)]
    return _class_sums(df, by, num_classes, ignore_index).select(*by, _mean(value).alias("dice"))


def iou(df: DataFrame, by: Sequence[str] = (), num_classes: int = 2, ignore_index: int = -100) -> DataFrame:
    """Mean over the foreground classes that occur in truth; 0 if none does."""
    value = [F.when(F.col(f"t{c}") > 0, F.col(f"i{c}") / (F.col(f"t{c}") + F.col(f"p{c}") - F.col(f"i{c}"))) for c in range(1, num_classes)]
    return _class_sums(df, by, num_classes, ignore_index).select(*by, _mean(value).alias("iou"))


def accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col("true") == F.col("pred")).cast("int")).alias("accuracy"))


def semantic_report(head: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Accuracy, IoU and Dice of the semantic logit against sem_label, or else label."""
    target = F.coalesce("sem_label", "label") if "sem_label" in head.columns else F.col("label")
    pairs = head.select(*by, (1 / (1 + F.exp(-F.col("sem"))) > threshold).cast("int").alias("pred"), (target > 0).cast("int").alias("true"))
    return accuracy(pairs, by).join(iou(pairs, by), list(by)).join(dice(pairs, by), list(by))


def instance_report(df: DataFrame, by: Sequence[str], scratch: Scratch | None = None) -> DataFrame:
    """(by, metric, value) of ari, ami, voi, voi_split, voi_merge and ted inside the true foreground; samples without any are left out.

    All come from one contingency table, which is kept, so what gives the labels runs once.
    """
    counts = (scratch or Scratch(df.sparkSession, "report")).keep(contingency(df.where(F.col("true") > 0), by), "counts")
    sums = _ami(counts, by, True, _sums(counts, by, True))
    wide = sums.select(*by, _ari(), _adjusted(), *_voi(), _ted().cast("double").alias("ted"))
    return wide.unpivot(list(by), ["ari", "ami", "voi", "voi_split", "voi_merge", "ted"], "metric", "value")


def metric_accumulate(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Weighted mean per key; keys without weight are dropped."""
    v, w = F.col(value), F.col(weight)
    return df.groupBy(key).agg((F.sum(v * w) / F.nullif(F.sum(w), F.lit(0))).alias("mean"), F.sum(w).alias("weight")).where("weight > 0")
