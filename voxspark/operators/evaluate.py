"""Validation straight from a model's head: agglomerate, then measure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .graph import agglomerate
from .metrics import instance_report


def instance_report_of_head(head: DataFrame, offsets: Sequence[Sequence[int]], n_pull: int, aff: str = "aff", label: str = "label", strides: Sequence[int] = (1, 4, 4), min_size: int = 0, max_push_edges: int | None = None, by: Sequence[str] = ("sample_id",), method: str = "exact", buckets: int = 16) -> DataFrame:
    """(by, metric, value) of ari, ami, voi, voi_split, voi_merge and ted of head(by, z, y, x, aff, label).

    Each sample's affinities (probabilities) are agglomerated inside its true foreground, which keeps
    errors of the foreground out of the figures; samples without any are left out.
    """
    inside = head.withColumns({"_fg": F.col(label) > 0, "_true": F.col(label)})
    found = agglomerate(inside, offsets, n_pull, aff, "_fg", strides, min_size, max_push_edges, by, method, buckets, carry=["_true"])
    return instance_report(found.select(*by, F.col("_true").alias("true"), F.col("label").alias("pred")), by)
