"""Chunked corpora and the exchange of keys between chunks.

Counting tens of billions of 64-bit keys as single rows wastes most of the
shuffle on row headers.  Here a corpus is held as *chunk rows* (some MB of
documents each, in a table bucketed by chunk); a chunk sends its distinct keys,
pre-aggregated, as packed arrays to the *key buckets*; a bucket merges equal keys
of all chunks and replies to each chunk in the order of what it sent.  A key that
is hot in the corpus reaches its bucket at most once from each chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bytehash import U, as_bytes
from ..scratch import Scratch

SENT = "kind string, chunk long, bucket int, keys binary, values binary"
REPLY = "kind string, chunk long, bucket int, reply binary, note binary"


def corpus_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def n_chunks(total_bytes: int, chunk_bytes: int) -> int:
    return max(16, min(50_000, math.ceil(total_bytes / chunk_bytes)))


def gather(batches: Iterator[pd.DataFrame], chunk_bytes: int, column: str = "text", row_bytes: int = 0):
    """(chunk id, documents) with texts as bytes.  A chunk is full with the row that brings it to chunk_bytes;
    row_bytes, added for each row, bounds the rows of a chunk of empty texts."""
    base, seq, size, held = TaskContext.get().partitionId() << 32, 0, 0, []
    for pdf in batches:
        texts = [as_bytes(t) for t in pdf[column]]
        start = 0
        for k, text in enumerate(texts):
            size += len(text) + row_bytes
            if size >= chunk_bytes:
                held.append(pdf.iloc[start : k + 1].assign(**{column: texts[start : k + 1]}))
                yield base + seq, pd.concat(held, ignore_index=True)
                held, size, seq, start = [], 0, seq + 1, k + 1
        if start < len(texts):
            held.append(pdf.iloc[start:].assign(**{column: texts[start:]}))
    if held:
        yield base + seq, pd.concat(held, ignore_index=True)


def squeeze(values: np.ndarray) -> bytes:
    """Counts, flags and ids are mostly small and alike: packed byte by byte of their width they take a fraction."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize * values[:1].size if len(values) else 1).T
    return zstandard.compress(planes.tobytes(), 1)


def expand(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences: the low bytes as they are, the high ones, mostly zero, packed."""
    planes = np.diff(keys, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return len(keys).to_bytes(4, "little") + planes[:5].tobytes() + squeeze(np.ascontiguousarray(planes[5:].T))


def unpack_keys(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.empty((n, 8), dtype=np.uint8)
    planes[:, :5] = np.frombuffer(data, dtype=np.uint8, count=5 * n, offset=4).reshape(5, n).T
    planes[:, 5:] = expand(data[4 + 5 * n :], np.dtype("V3")).view(np.uint8).reshape(n, 3)
    return np.cumsum(planes.view("<u8").ravel(), dtype=U)


def pack_sent(kind: str, chunk: int, keys: np.ndarray, values: np.ndarray, buckets: int) -> pd.DataFrame:
    """Rows for the buckets; keys must be sorted and distinct.  A bucket is a range of keys."""
    cut = np.searchsorted(keys, range_starts(buckets))
    cut = np.append(cut, len(keys))
    rows = [
        (kind, chunk, b, pack_keys(keys[i:j]), squeeze(values[i:j]))
        for b, (i, j) in enumerate(zip(cut[:-1], cut[1:]))
        if j > i
    ]
    return pd.DataFrame(rows, columns=["kind", "chunk", "bucket", "keys", "values"])


def range_starts(buckets: int) -> np.ndarray:
    return np.array([(b << 64) // buckets for b in range(buckets)], dtype=U)


def reduce_keys(sent: DataFrame, answers: dict[str, Callable[[np.ndarray, np.ndarray, int, np.ndarray], tuple[np.ndarray, bytes | None]]], types: dict[str, list | str]) -> DataFrame:
    """Merge each bucket of each kind of keys.

    answers[kind](inverse, values, n, keys) gets, for all entries of a bucket, the index
    of their key among its n distinct keys, and their values and keys; entries stand in
    the order of their chunks.  It returns one reply per entry and a note on the bucket, which
    is kept in the column `note` of one of its rows.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk", kind="stable")
        kind = pdf["kind"].iloc[0]
        parts = [unpack_keys(k) for k in pdf["keys"]]
        cut = np.cumsum([0, *map(len, parts)])
        keys = np.concatenate(parts)
        values = np.concatenate([expand(v, types[kind]) for v in pdf["values"]])
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = ranked[1:] != ranked[:-1]
        inverse = np.empty(len(keys), dtype=np.int64)
        inverse[order] = np.cumsum(new) - 1
        replies, note = answers[kind](inverse, values, int(new.sum()), keys)
        notes = [note] + [None] * (len(pdf) - 1)
        return pd.DataFrame({"kind": kind, "chunk": pdf["chunk"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "reply": [squeeze(replies[i:j]) for i, j in zip(cut[:-1], cut[1:])], "note": notes})

    return sent.groupBy("kind", "bucket").applyInPandas(merge, REPLY)


def first_of_key(inverse: np.ndarray, n: int) -> np.ndarray:
    """True at the first entry of each key."""
    first = np.full(n, len(inverse), dtype=np.int64)
    np.minimum.at(first, inverse, np.arange(len(inverse)))
    out = np.zeros(len(inverse), dtype=bool)
    out[first] = True
    return out


def with_replies(store: DataFrame, buckets: int, **replies: DataFrame) -> DataFrame:
    """The chunk rows with each kind of replies as an array column, in bucket order.

    The store is in `buckets` buckets by chunk and stays in place; only the replies move, once.
    """
    for name, df in replies.items():
        got = df.where(F.col("kind") == name).repartition(buckets, "chunk").groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "reply"))), lambda x: x["reply"]).alias(name))
        store = store.join(got, "chunk", "left")
    return store


def unpack_reply(parts, dtype: str) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype=dtype), *(expand(p, dtype) for p in (parts if parts is not None else ()))])
