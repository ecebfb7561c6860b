"""How many voxels of many boxes have a property: boxes meet stored blocks, not voxels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .blocks import AXES, Blocks, block_rows

SIDES = ("sz", "sy", "sx")


def box_counts(voxels: DataFrame | Blocks, column: str, boxes: DataFrame, by: str = "volume", block: Sequence[int] = (32, 128, 128), per_task: int = 100_000) -> DataFrame:
    """(box, n, voxels) of boxes(box, by, z, y, x, sz, sy, sx): their voxels whose column is above 0 (or true), and all present ones; boxes without any are left out.

    A box goes to the blocks that it touches; there a summed-area table gives its share in eight
    look-ups, whatever its size.  A block that more than per_task boxes touch is sent to several tasks.
    """
    packed, kinds = block_rows(voxels, [column], (by,), block)
    cells = [f"b{a}" for a in AXES]
    touching = boxes.select("box", F.col(by).alias("_volume"), *AXES, *SIDES)
    for a, s, c, b in zip(AXES, SIDES, cells, block):
        touching = touching.withColumn(c, F.explode(F.sequence(F.floor(F.col(a) / b).cast("int"), F.floor((F.col(a) + F.col(s) - 1) / b).cast("int"))))
    parts = touching.groupBy("_volume", *cells).agg(F.ceil(F.count("*") / per_task).cast("int").alias("_parts"))
    wanted = parts.withColumnsRenamed({c: f"_{c}" for c in cells})
    blocks = packed.join(wanted, [packed[by].eqNullSafe(wanted["_volume"]), *(packed[c] == wanted[f"_{c}"] for c in cells)])
    blocks = blocks.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(F.col(by).alias("_volume"), *cells, "_part", "present", column)
    counts = parts.select(F.col("_volume").alias("_same"), *(F.col(c).alias(f"_{c}") for c in cells), "_parts")
    dealt = touching.join(counts, [touching["_volume"].eqNullSafe(counts["_same"]), *(touching[c] == counts[f"_{c}"] for c in cells)])
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("box"), F.col("_parts")).cast("int")).select("box", "_volume", *cells, "_part", *AXES, *SIDES)
    kind = boxes.schema["box"].dataType

    def count(key: tuple, stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"box": asked["box"], "n": np.zeros(len(asked), dtype=np.int64), "voxels": np.zeros(len(asked), dtype=np.int64)})
        for row in stored.to_dict("records"):
            there = np.frombuffer(row["present"], dtype="?").reshape(block)
            low = [np.clip(asked[a].to_numpy() - row[c] * b, 0, b) for a, c, b in zip(AXES, cells, block)]
            high = [np.clip(asked[a].to_numpy() + asked[s].to_numpy() - row[c] * b, 0, b) for a, s, c, b in zip(AXES, SIDES, cells, block)]
            for name, counted in (("n", there & (np.frombuffer(row[column], dtype=kinds[column]).reshape(block) > 0)), ("voxels", there)):
                sums = np.zeros([b + 1 for b in block], dtype=np.int64)
                sums[1:, 1:, 1:] = counted.cumsum(0).cumsum(1).cumsum(2)
                for corner in range(8):
                    at = [(high if corner >> k & 1 else low)[k] for k in range(3)]
                    out[name] += (1 if corner.bit_count() % 2 else -1) * sums[at[0], at[1], at[2]]
        return out[out["voxels"] > 0]

    keys = ["_volume", *cells, "_part"]
    found = blocks.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(count, T.StructType([T.StructField("box", kind), T.StructField("n", T.LongType()), T.StructField("voxels", T.LongType())]))
    return found.groupBy("box").agg(F.sum("n").alias("n"), F.sum("voxels").alias("voxels"))
