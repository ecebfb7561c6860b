"""Vector codes: each part of a vector becomes the number of its codebook's nearest entry.

Components become whole numbers, floor(scale * x), and vectors are cut into equal parts.
The nearest entry is found by slices: for each dimension of a part the codebook's
coordinates are sorted and carry masks of 64 bits, one for each prefix of the order.  The
distance to the entry that is next in one dimension gives an initial radius; in each
dimension the entries within that radius are a range of the order, which is the
difference of two prefix masks.  All dimensions' masks ANDed leave the entries of a
box around the part that holds its nearest one; only their distances are computed.

Codebooks begin as the parts of the rows with the smallest ids.  A round assigns all
rows' parts, adds up each entry's parts in the tasks, and moves each entry to the mean
of its parts, rounded down; entries without parts stay.  A round brings one row for each
part, entry and task together: the driver sees codebooks only.

Results for odd inputs: rows whose vector is null, empty, or holds null or non-finite
components are dropped, and so are those whose length is not that of the vector with the
smallest id (among those that can be cut into equal parts); rows with null ids are coded
like others and begin codebooks only where fewer rows have ids; rows that share an id are
rows of their own, ordered by their vectors; equal entries give the one with the lower
number; with fewer rows than entries the codebooks are smaller; null labels are one label;
an empty table gives no rows; other columns are dropped, whatever their names.  Components
beyond 2**26 / scale count as the nearest whole number within 2**26, so that no sum passes 64 bits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..scratch import Scratch

EDGE = 1 << 26
SUMS = "part int, entry int, position int, n long, total long"
CODED = "vec_id long, label string, code string, error long"


@dataclass(frozen=True)
class CodeParams:
    parts: int = 16
    entries: int = 64  # at most 64: one bit each
    rounds: int = 2
    scale: int = 256
    batch: int = 8192  # vectors that a task codes at a time
    hot_share: int = 200  # a label of over 1 / hot_share of all rows is hot


class Slices:
    """One part's codebook with its sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # (entry, position), whole numbers
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        self.order = order
        bits = np.left_shift(np.uint64(1), order.astype(np.uint64))
        self.prefix = np.zeros((len(entries) + 1, entries.shape[1]), dtype=np.uint64)
        np.bitwise_or.accumulate(bits, axis=0, out=self.prefix[1:])

    def radius(self, parts: np.ndarray) -> np.ndarray:
        """A squared distance that some entry is within: of those next in one dimension each, the nearest's."""
        best = np.full(len(parts), np.iinfo(np.int64).max)
        for d in range(parts.shape[1]):
            at = np.minimum(np.searchsorted(self.sorted[:, d], parts[:, d]), len(self.entries) - 1)
            gap = parts - self.entries[self.order[at, d]]
            np.minimum(best, (gap * gap).sum(axis=1), out=best)
        return best

    def masks(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """The entries whose every coordinate is within the radius, one bit each."""
        reach = np.sqrt(radius.astype(np.float64)).astype(np.int64) + 1
        out = np.full(len(parts), ~np.uint64(0))
        for d in range(parts.shape[1]):
            low = np.searchsorted(self.sorted[:, d], parts[:, d] - reach, "left")
            high = np.searchsorted(self.sorted[:, d], parts[:, d] + reach, "right")
            out &= self.prefix[high, d] ^ self.prefix[low, d]
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each part's nearest entry; of equal distances the lower number."""
        mask = self.masks(parts, self.radius(parts))
        entry, distance = np.zeros(len(parts), dtype=np.int64), np.full(len(parts), np.iinfo(np.int64).max)
        live = np.arange(len(parts))
        while len(live):
            low = mask & (~mask + np.uint64(1))  # the lowest bit that is left
            at = np.bitwise_count(low - np.uint64(1)).astype(np.int64)
            gap = parts[live] - self.entries[at]
            now = (gap * gap).sum(axis=1)
            nearer = now < distance[live]
            entry[live[nearer]], distance[live[nearer]] = at[nearer], now[nearer]
            mask ^= low
            more = mask != 0
            live, mask = live[more], mask[more]
        return entry, distance


def whole_numbers(vectors, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, rows by components."""
    out = np.floor(np.array(vectors.tolist(), dtype=np.float64) * scale)
    return np.clip(out, -EDGE, EDGE).astype(np.int64)


def _blocks(frames, p: CodeParams):
    for pdf in frames:
        for start in range(0, len(pdf), p.batch):
            part = pdf.iloc[start : start + p.batch]
            if len(part):
                numbers = whole_numbers(part["v"], p.scale)
                yield part, numbers.reshape(len(part), p.parts, -1)


def usable(vectors: DataFrame, vec_id: str, vector: str, label: str | None, parts: int) -> DataFrame:
    """(vec_id, label, v) of the rows that are coded."""
    v = F.col(vector).cast("array<double>")
    kind = (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("label")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), kind, v.alias("v"))
    rows = rows.where(F.coalesce(F.size("v") > 0, F.lit(False)) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.where(F.size("v") % parts == 0)


def _smallest(rows: DataFrame, n: int) -> list:
    return rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(n).collect()  # a few rows


def _assigned_sums(codebooks: list[np.ndarray], p: CodeParams):
    def sums(frames):
        books = [Slices(c) for c in codebooks]
        count = [np.zeros(len(c), dtype=np.int64) for c in codebooks]
        total = [np.zeros_like(c) for c in codebooks]
        for _, numbers in _blocks(frames, p):
            for k, book in enumerate(books):
                entry, _ = book.nearest(numbers[:, k])
                count[k] += np.bincount(entry, minlength=len(book.entries))
                np.add.at(total[k], entry, numbers[:, k])
        for k in range(len(books)):
            used = np.flatnonzero(count[k])
            if len(used):
                width = total[k].shape[1]
                yield pd.DataFrame({"part": k, "entry": np.repeat(used, width), "position": np.tile(np.arange(width), len(used)), "n": np.repeat(count[k][used], width), "total": total[k][used].ravel()})

    return sums


def fit_codebooks(rows: DataFrame, params: CodeParams = CodeParams()) -> list[np.ndarray]:
    """One array (entry, position) for each part; rows are those of :func:`usable`, of one length."""
    p = params
    if not 0 < p.entries <= 64:
        raise ValueError("a codebook has at most 64 entries, one for each bit of a mask")
    first = _smallest(rows, p.entries)
    if not first:
        return []
    start = whole_numbers(pd.Series([r.v for r in first]), p.scale).reshape(len(first), p.parts, -1)
    books = [np.ascontiguousarray(start[:, k]) for k in range(p.parts)]
    for _ in range(p.rounds):
        sums = rows.select("v").mapInPandas(_assigned_sums(books, p), SUMS)
        for r in sums.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # one number a component of the codebooks
            books[r.part][r.entry, r.position] = r.total // r.n
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = None, params: CodeParams = CodeParams(), scratch: Scratch | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error), codebooks): codes as two hex digits a part, errors as sums of squared distances."""
    p = params
    scratch = scratch or Scratch(vectors.sparkSession, "codes")
    rows = usable(vectors, vec_id, vector, label, p.parts)
    one = _smallest(rows, 1)
    if one:
        rows = rows.where(F.size("v") == len(one[0].v))
    books = fit_codebooks(rows, p)

    def code(frames):
        slices = [Slices(b) for b in books]
        for part, numbers in _blocks(frames, p):
            found = [s.nearest(numbers[:, k]) for k, s in enumerate(slices)]
            codes = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            width = 2 * p.parts
            yield pd.DataFrame({
                "vec_id": part["vec_id"].astype("Int64"), "label": part["label"], "code": [codes[i : i + width] for i in range(0, len(codes), width)],
                "error": sum(distance for _, distance in found),
            })

    return scratch.keep(rows.mapInPandas(code, CODED), "codes"), books


def decode(codes: DataFrame, books: list[np.ndarray], params: CodeParams = CodeParams(), column: str = "code") -> DataFrame:
    """codes with the column `approximation`: the entries that they name, divided by the scale."""

    @F.pandas_udf("array<double>")
    def entries(code: pd.Series) -> pd.Series:
        numbers = [bytes.fromhex(c) for c in code]
        return pd.Series([np.concatenate([books[k][e] for k, e in enumerate(c)]) / params.scale for c in numbers])

    return codes.withColumn("approximation", entries(column))


def with_label_errors(coded: DataFrame, params: CodeParams = CodeParams()) -> DataFrame:
    """coded with label_error, the error summed over equal labels.

    A hot label (there are fewer than `hot_share` of them) goes to its rows by broadcast, the others,
    each with a small share of the rows, by an exchange.
    """
    n = coded.count()
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    hot = sums.where(F.col("rows") * params.hot_share > n).select("of", "label_error", F.lit(True).alias("hot"))
    marked = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    done = marked.where("hot").drop("hot")
    cold = sums.where(F.col("rows") * params.hot_share <= n).select("of", "label_error")
    rest = marked.where("hot IS NULL").drop("hot", "label_error").join(cold.hint("shuffle_hash"), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    return done.unionByName(rest)


def code_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", params: CodeParams = CodeParams(), scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row that is coded."""
    scratch = scratch or Scratch(vectors.sparkSession, "codes")
    coded, books = encode(vectors, vec_id, vector, label, params, scratch)
    out = with_label_errors(coded, params).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
    return scratch.finish(out)
