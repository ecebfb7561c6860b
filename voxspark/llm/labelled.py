"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .bytehash import U, Rolling, as_bytes, combine, join_texts, mix, word_spans


def binary_labels(labels: DataFrame, column: str, learn: Column) -> DataFrame:
    """(doc_id, y) of the rows to learn from; of a document's several labels the largest counts."""
    usable = labels.where(F.col(column).isin(0, 1) & F.coalesce(learn, F.lit(False)) & F.col("doc_id").isNotNull())
    return usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("y"))


def sample_texts(docs: DataFrame, labelled: DataFrame, per_class: tuple[int, int], max_bytes: int) -> tuple[list[bytes], list[int], list[int]]:
    """Texts and classes of at most per_class[y] documents of class y, and the numbers of labelled rows of both.

    Chosen by a hash of the id, so alike at every size.  Documents of more than
    max_bytes bytes are not learnt from, so that the sample's size is bounded.
    """
    counts = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    parts = [labelled.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(per_class[y]) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # sum(per_class) rows at most
    fit = docs.where(F.octet_length("text") <= max_bytes).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = fit.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y")).orderBy("doc_id").collect()
    texts = [as_bytes(r["text"]) for r in rows]
    unlike = different(texts)
    return [texts[k] for k in unlike], [rows[k]["y"] for k in unlike], [counts.get(0, 0), counts.get(1, 0)]


def different(texts: list[bytes], draws: int = 6) -> list[int]:
    """Which texts of a sample to learn from: copies of one before, by minimal hashes of their triples of words, teach nothing new."""
    seen, out = set(), []
    for k, t in enumerate(texts):
        data, _ = join_texts([t], 1)
        words = Rolling(data).slices(*word_spans(data))
        if len(words) > 2:
            words = combine(words[:-2], words[1:-1], words[2:])
        low = [int(mix(words ^ U(d)).min()) if len(words) else 0 for d in range(1, draws + 1)]
        marks = [(d, *low[d : d + 2]) for d in range(0, draws, 2)]
        if not seen.intersection(marks):
            out.append(k)
        seen.update(marks)
    return out


def scored(docs: DataFrame, score, column: str = "score") -> DataFrame:
    """docs with a column of score(list of texts as bytes), computed batch by batch."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for k in range(0, len(texts), 256):
                out.extend(score([as_bytes(t) for t in texts.iloc[k : k + 256]]))
            yield pd.Series(out, dtype="float64")

    return docs.withColumn(column, run("text"))
