"""Exact top-k inner products by columnar branch and bound.

Vectors become integers, floor(scale * x).  A task holds a block of candidates in
vertical layout, one row a dimension.  For each query it takes the dimensions in
order of the query's magnitude and a few at a time: it adds their products to the
candidates' scores, bounds what the other dimensions can still add by the product of
the remaining lengths (Cauchy-Schwarz), and keeps only candidates whose upper bound
reaches the k-th best lower bound.  Queries and candidates meet block by block, of as many vectors as a task holds
well; each block's k best of each query are merged in the end.  A candidate is sent once for each
block of queries and a query once for each block of candidates, so large blocks are what keeps the exchange small.

Results for odd inputs: vectors that are null, empty, or hold null or non-finite
components take no part, zero vectors do; a query's own row is no candidate, other
rows with its id are; vectors of different lengths are not compared; rows with a null
id are candidates and no queries, and lose ties; equal rows are candidates each; an
empty table gives no rows; other columns are dropped, whatever their names.  Products
that double precision can't tell apart are computed as whole numbers for the candidates
that the bounds leave; a score beyond 64 bits is given as the largest or smallest long,
and components beyond 2**63 / scale as the nearest whole number that a long holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import Scratch

FOUND = "query_row long, query_id long, row long, vec_id long, score long"


LONG = np.iinfo(np.int64)
EDGE = 2.0**63 * (1 - 1e-6)


@dataclass(frozen=True)
class TopKParams:
    k: int = 10
    scale: int = 1024
    dims: int = 16
    block_bytes: int = 32 << 20  # of a block of candidates, and of one of queries, as double precision numbers


def best(query: np.ndarray, columns: np.ndarray, squares: np.ndarray, k: int, dims: int, rounding: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that can be among the k best of one query, and their scores.

    columns[d, i]: dimension d of candidate i, whole numbers in double precision;
    squares[i]: squared length of candidate i; rounding: the share of the product of both
    lengths by which a score or a bound can be off.
    """
    order = np.argsort(-np.abs(query), kind="stable")
    rest = np.sqrt(np.maximum(0, np.cumsum((query[order] ** 2)[::-1])[::-1]))
    alive, score, left = np.arange(columns.shape[1]), np.zeros(columns.shape[1]), squares.astype(np.float64)
    error = rounding * rest[0] * np.sqrt(squares) + 1e-6
    for start in range(0, len(query), dims):
        at = order[start : start + dims]
        block = columns[at] if len(alive) == columns.shape[1] else columns[np.ix_(at, alive)]
        score = score + query[at] @ block
        stop = start + dims
        if (stop >= len(query) and not rounding) or len(alive) <= k:
            continue
        left = left - (block * block).sum(axis=0)
        slack = error[alive]
        if stop < len(query):
            slack = slack + rest[stop] * np.sqrt(np.maximum(left, 0)) * (1 + 1e-9)
        floor = np.partition(score - slack, len(alive) - k)[len(alive) - k]
        if rounding and abs(floor) >= EDGE:  # scores that no long holds are equal
            floor = EDGE if floor > 0 else -np.inf
        keep = score + slack >= floor
        if not keep.all():
            alive, score, left = alive[keep], score[keep], left[keep]
    return alive, score


def _search(params: TopKParams):
    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            whole = np.array(rows["v"].tolist(), dtype=np.float64)
            asked = np.array(queries["v"].tolist(), dtype=np.float64)
            columns, squares = np.ascontiguousarray(whole.T), (whole * whole).sum(axis=1)
            exact = float(squares.max(initial=0)) < 2**52 and float((asked * asked).sum(axis=1).max(initial=0)) < 2**52  # so are all sums of products
            row, vec = rows["row"].to_numpy(), rows["vec_id"].fillna(LONG.max).to_numpy(dtype=np.int64)
            for q, query_row, query_id in zip(asked, queries["row"], queries["vec_id"]):
                alive, score = best(q, columns, squares, params.k + 1, params.dims, 0.0 if exact else 1e-7)  # one more: its own row
                other = row[alive] != query_row
                alive, score = alive[other], score[other]
                if exact:
                    top = np.lexsort((vec[alive], -score))[: params.k]
                    score = score[top].astype(np.int64)
                else:
                    number = [max(LONG.min, min(LONG.max, sum(int(a) * int(b) for a, b in zip(q, whole[i])))) for i in alive]
                    top = np.array(sorted(range(len(alive)), key=lambda i: (-number[i], vec[alive[i]]))[: params.k], dtype=np.int64)  # noqa: B023
                    score = np.array([number[i] for i in top], dtype=np.int64)
                found = {"query_row": query_row, "query_id": query_id, "row": row[alive[top]], "vec_id": rows["vec_id"].to_numpy()[alive[top]], "score": score}
                out.append(pd.DataFrame(found))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_row", "query_id", "row", "vec_id", "score")})

    return search


def top_products(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", params: TopKParams = TopKParams(), scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row."""
    scratch = scratch or Scratch(vectors.sparkSession, "topk")
    v = F.col(vector).cast("array<double>")
    whole = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("query"), v.alias("v"))
    whole = whole.where(F.coalesce(F.size("v") > 0, F.lit(False)) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = whole.withColumn("v", F.transform("v", lambda x: F.floor(x * params.scale).cast("double"))).withColumn("size", F.size("v"))
    whole = scratch.keep(whole.withColumn("row", F.monotonically_increasing_id()), "whole")
    n_bytes, query_bytes = whole.agg(F.sum(8 * F.col("size").cast("long")), F.sum(F.when(F.col("query"), 8 * F.col("size").cast("long")))).first()
    blocks, parts = max(8, -(-(n_bytes or 0) // params.block_bytes)), max(1, -(-(query_bytes or 0) // params.block_bytes))
    deal = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = whole.select("size", deal(blocks).alias("block"), spread(parts).alias("part"), "row", "vec_id", "v")
    asked = whole.where("query").select("size", spread(blocks).alias("block"), deal(parts).alias("part"), "row", "vec_id", "v")
    by = ("size", "block", "part")
    found = asked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(_search(params), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return scratch.finish(found.withColumn("rank", rank).where(F.col("rank") <= params.k).select("query_id", "rank", "vec_id", "score"))
