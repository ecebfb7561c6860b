"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are normalised, so that cosine >= t means a distance of at most
sqrt(2 - 2t).  A table hashes a vector by ``k`` Gaussian projections, each shifted at
random and cut into cells ``width`` wide; vectors of one cell are candidates and are
checked by their exact cosine in double precision.  ``k`` follows the number of
vectors, so that a cell keeps some ``fill`` unrelated vectors; the number of tables
follows from it and from ``miss``, the chance that a pair just at the threshold meets in no
table (closer pairs are missed far less).

Equal vectors are joined before hashing.  A pair that meets in several tables counts
in the first one only, which its members' cells in the earlier tables tell, so links are
counted without listing pairs.  A cell of more than ``hot_cell`` vectors is dealt out as
pairs of blocks.

Results for odd inputs: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are their own component; vectors of different
lengths don't link; each of several rows with one id counts as a vector; an empty table gives
no rows; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.components import connected, local_roots
from ..scratch import Scratch


@dataclass(frozen=True)
class PStableParams:
    threshold: float = 0.95
    cells: float = 8.0  # width of a cell, in distances at the threshold
    fill: float = 20.0
    miss: float = 1e-4
    seed: int = 7
    hot_cell: int = 4096
    hot_share: int = 1000  # a vector that over 1 / hot_share of the rows hold is hot

    @property
    def width(self) -> float:
        return self.cells * math.sqrt(2 - 2 * self.threshold)

    def meets(self, distance: float) -> float:
        """Chance that one projection puts two vectors at this distance into one cell."""
        r = self.width / distance
        return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))

    def shape(self, n: int) -> tuple[int, int]:
        """Projections a table and tables, for n vectors."""
        far = self.meets(math.sqrt(2))
        k = max(2, math.ceil(math.log(max(2.0, n / self.fill)) / -math.log(far)))
        return k, math.ceil(math.log(self.miss) / math.log(1 - self.meets(math.sqrt(2 - 2 * self.threshold)) ** k))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths, in double precision; safe for very large and small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(x: np.ndarray, params: PStableParams, k: int, tables: int) -> np.ndarray:
    """The cell of each unit vector in each table, as 32-bit keys."""
    rng = np.random.default_rng(params.seed)
    out = np.empty((len(x), tables), dtype=np.uint32)
    for t in range(tables):
        axes, shift = rng.standard_normal((x.shape[1], k)), rng.random(k) * params.width
        step = np.floor((x @ axes + shift) / params.width).astype(np.int64)
        key = np.full(len(x), 0x9E3779B97F4A7C15 + t, dtype=np.uint64)
        for j in range(k):
            key = (key ^ step[:, j].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
        out[:, t] = key >> np.uint64(32)
    return out


def _pairs_of_cell(x, sig, table: int, threshold: float, a: slice, b: slice):
    """Linked pairs between two ranges of a cell's rows that meet first in this table, block by block."""
    whole = a == b
    for start in range(a.start, a.stop, 128):
        rows = slice(start, min(a.stop, start + 128))
        i, j = np.nonzero(x[rows] @ x[b].T >= threshold)
        i, j = i + rows.start, j + b.start
        if whole:
            i, j = i[i < j], j[i < j]
        if table and len(i):
            first = np.ones(len(i), dtype=bool)
            for t in range(table):
                first &= sig[i, t] != sig[j, t]
            i, j = i[first], j[first]
        if len(i):
            yield i, j


def _link(frames, threshold: float):
    """Links and stars of sorted cell rows; a cell may spread over several frames."""

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = ["size", "table", "cell", "pair"]
        change = (pdf[cols].to_numpy()[1:] != pdf[cols].to_numpy()[:-1]).any(axis=1)
        start = np.flatnonzero(np.concatenate([[True], change]))
        end = np.append(start[1:], len(pdf))
        key, copies = pdf["key"].to_numpy(), pdf["copies"].to_numpy()
        table, block, two = pdf["table"].to_numpy(), pdf["block"].to_numpy(), pdf["two"].to_numpy()
        vectors, sigs = pdf["vector"].to_numpy(), pdf["sig"].to_numpy()
        keys, others, counts = [], [], []
        for s, e in zip(start, end):
            if e - s < 2:
                continue
            x = unit(np.frombuffer(b"".join(vectors[s:e]), dtype=np.float64).reshape(e - s, -1))
            sig = np.frombuffer(b"".join(sigs[s:e]), dtype=np.uint32).reshape(e - s, -1)
            mid = int(np.searchsorted(block[s:e], block[s], "right")) if two[s] else e - s
            a, b = (slice(0, mid), slice(mid, e - s)) if two[s] else (slice(0, e - s),) * 2
            count, label = np.zeros(e - s, dtype=np.int64), np.arange(e - s)
            for i, j in _pairs_of_cell(x, sig, int(table[s]), threshold, a, b):
                np.add.at(count, i, copies[s:e][j])
                np.add.at(count, j, copies[s:e][i])
                node, root = local_roots(np.concatenate([i, np.arange(e - s)]), np.concatenate([j, label]))
                label[node] = root
            hit = np.flatnonzero(count)
            keys.append(key[s:e][hit])
            others.append(key[s:e][label[hit]])
            counts.append(count[hit])
        join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        return pd.DataFrame({"key": join(keys), "other": join(others), "links": join(counts)})

    held: list[pd.DataFrame] = []  # frames of which the last cell may go on; they are put together once
    cols = ["size", "table", "cell", "pair"]
    for pdf in frames:
        if not len(pdf):
            continue
        same = (pdf[cols] == pdf[cols].iloc[-1]).all(axis=1).to_numpy()
        whole = int((~same).sum())
        if held and not whole and (held[-1][cols].iloc[-1] != pdf[cols].iloc[-1]).any():
            yield finish(pd.concat(held, ignore_index=True))
            held = []
        if whole:
            yield finish(pd.concat([*held, pdf.iloc[:whole]], ignore_index=True))
            held, pdf = [], pdf.iloc[whole:]
        held.append(pdf)
    if held:
        yield finish(pd.concat(held, ignore_index=True))


def usable(vector: str):
    """Whether a vector takes part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", params: PStableParams = PStableParams(), scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    scratch = scratch or Scratch(vectors.sparkSession, "pstable")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    good = rows.where(usable("v")).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    distinct = good.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    distinct = scratch.keep(distinct.withColumn("key", F.monotonically_increasing_id()), "distinct")
    k, tables = params.shape(distinct.count())

    def hashed(frames):
        for pdf in frames:
            for size, part in pdf.groupby(pdf["v"].map(len)):
                x = np.array(part["v"].tolist(), dtype=np.float64)
                sig = cells(unit(x), params, k, tables)
                yield pd.DataFrame({"key": part["key"], "copies": part["copies"], "size": size, "vector": [r.tobytes() for r in x], "sig": [r.tobytes() for r in sig], "cells": list(sig.astype(np.int64))})

    sigs = distinct.select("key", "copies", "v").mapInPandas(hashed, "key long, copies long, size int, vector binary, sig binary, cells array<long>")
    sigs = scratch.keep(sigs, "cells")
    at = sigs.select("size", "key", F.posexplode("cells").alias("table", "cell"))
    per_cell = at.groupBy("size", "table", "cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.keep(per_cell.withColumn("blocks", F.ceil(F.col("n") / params.hot_cell).cast("int")).select("size", "table", "cell", "blocks"), "shared")
    met = at.join(shared, ["size", "table", "cell"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = met.select("*", other).withColumn("pair", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
    met = met.withColumn("two", F.col("block") != F.col("other"))
    # blocks of pairs (b, b) hold one block; pairs (a, b) hold both
    full = met.join(sigs.select("key", "copies", "vector", "sig"), "key")
    full = full.repartition("size", "table", "cell", "pair").sortWithinPartitions("size", "table", "cell", "pair", "block")
    links = full.select("size", "table", "cell", "pair", "block", "two", "key", "copies", "vector", "sig")
    links = links.mapInPandas(lambda it: _link(it, params.threshold), T.StructType([T.StructField(c, T.LongType()) for c in ("key", "other", "links")]))
    links = scratch.keep(links, "links")

    n_links = links.groupBy("key").agg(F.sum("links").alias("links"))
    of = connected(links.select(F.col("key").alias("a"), F.col("other").alias("b")), scratch).select(F.col("node").alias("key"), "component")
    groups = distinct.join(of, "key", "left").withColumn("component", F.coalesce("component", "key"))
    smallest = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    known = groups.join(smallest, "component").join(n_links, "key", "left")
    known = scratch.keep(known.select("v", "copies", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    # vectors of very many copies (fewer than hot_share) go to their rows by broadcast, the others by an exchange
    rows_in_all = known.agg(F.sum("copies")).first()[0] or 0
    is_hot = F.col("copies") * params.hot_share > rows_in_all
    hot = known.where(is_hot).select("v", "component_id", "n_links", F.lit(True).alias("hot"))
    marked = good.join(F.broadcast(hot), "v", "left")
    rest = marked.where("hot IS NULL").select("vec_id", "v").join(known.where(~is_hot), "v")
    linked = marked.where("hot").select("vec_id", "n_links", "component_id").unionByName(rest.select("vec_id", "n_links", "component_id"))
    alone = rows.where(~usable("v")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return scratch.finish(linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
