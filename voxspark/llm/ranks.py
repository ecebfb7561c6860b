"""Lexicographic ranks of the byte strings that chunks hold.

A chunk sends its distinct strings, sorted and packed, to ranges of the lexicographic
order; a range sorts the strings of all chunks and replies with the rank of each: the
range's number and the place in it, so that ranks order as the strings do over the
whole corpus.  A string that is hot reaches its range once from each chunk.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from .bytehash import U
from .chunks import REPLY, expand, squeeze

RANK = 6  # bytes of a packed rank: two of the range, four of the place


def spread(start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. (lens[0] numbers), start[1], .."""
    stop = np.cumsum(lens)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - lens), lens)


def strings(buffer: np.ndarray, *parts: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """Strings that are joined from slices (starts, lengths) of the buffer, one slice of each part."""
    start, lens = (np.stack([np.asarray(p[i], dtype=np.int64) for p in parts], axis=1) for i in (0, 1))
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(lens.sum(axis=1), out=offsets[1:])
    held, start, lens = buffer.tobytes(), start.ravel(), lens.ravel()
    start, stop = start[lens > 0], (start + lens)[lens > 0]
    data = b"".join([held[i:j] for i, j in zip(start.tolist(), stop.tolist())])
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def in_order(held: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct strings in lexicographic order, and where each one's string stands."""
    coded = held.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


def raw(held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array that is not a slice."""
    _, offsets, data = held.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(held) + 1) if len(held) else np.zeros(1, dtype=np.int64)
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)


def pack_strings(kind: str, chunk: int, held: pa.Array, splits: list[bytes] | int) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows for the ranges, and where each string stands in the order of its replies.

    splits: where ranges begin, but the first; their number, if strings begin with a packed rank: those go to its range.
    """
    distinct, inverse = in_order(held)
    offsets, data = raw(distinct)
    if isinstance(splits, int):
        lead = data[offsets[:-1]].astype(np.int64) << 8 | data[offsets[:-1] + 1]
        cut = np.searchsorted(lead, np.arange(splits + 1)).tolist()
    else:
        held, every = data.tobytes(), range(len(distinct))
        cut = [0, *(bisect_left(every, s, key=lambda k: held[offsets[k] : offsets[k + 1]]) for s in splits), len(every)]
    twice = np.bincount(inverse, minlength=len(distinct)) > 1
    lens = np.diff(offsets).astype("<u4")
    rows = []
    for b, (i, j) in enumerate(zip(cut[:-1], cut[1:])):
        if j > i:
            head = squeeze(lens[i:j])
            keys = len(head).to_bytes(4, "little") + head + zstandard.compress(data[offsets[i] : offsets[j]].tobytes(), 1)
            rows.append((kind, chunk, b, keys, squeeze(twice[i:j].astype("u1"))))
    return pd.DataFrame(rows, columns=["kind", "chunk", "bucket", "keys", "values"]), inverse


def _unpack(data: bytes) -> tuple[np.ndarray, bytes]:
    head = int.from_bytes(data[:4], "little")
    return expand(data[4 : 4 + head], "<u4").astype(np.int64), zstandard.decompress(data[4 + head :])


def rank_strings(sent: DataFrame, answer: Callable[[pa.Array, np.ndarray], np.ndarray]) -> DataFrame:
    """Replies to the strings that chunks sent: ranks, and a mark that answer(distinct strings in order, places of each) gives."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(k) for k in pdf["keys"]]
        offsets = np.cumsum(np.concatenate([[0], *(p[0] for p in parts)]), dtype=np.int64)
        held = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(p[1] for p in parts))])
        distinct, place = in_order(held)
        twice = np.concatenate([expand(v, "u1") for v in pdf["values"]])
        marks = answer(distinct, np.bincount(place, 1 + twice, len(distinct))).astype("<u4")
        cut = np.cumsum([0, *(len(p[0]) for p in parts)])
        replies = []
        for b, i, j in zip(pdf["bucket"], cut[:-1], cut[1:]):
            ranks = squeeze(np.diff(place[i:j], prepend=0).astype("<u4"))
            replies.append(int(b).to_bytes(4, "little") + len(ranks).to_bytes(4, "little") + ranks + squeeze(marks[place[i:j]]))
        return pd.DataFrame({"kind": pdf["kind"], "chunk": pdf["chunk"], "bucket": pdf["bucket"], "reply": replies, "note": None})

    return sent.groupBy("kind", "bucket").applyInPandas(merge, REPLY)


def unpack_ranks(parts) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and marks of a chunk's distinct strings, in their order."""
    ranks, marks = [np.empty(0, dtype=U)], [np.empty(0, dtype=np.int64)]
    for part in parts if parts is not None else ():
        n = int.from_bytes(part[4:8], "little")
        ranks.append(np.cumsum(expand(part[8 : 8 + n], "<u4"), dtype=U) | U(int.from_bytes(part[:4], "little") << 32))
        marks.append(expand(part[8 + n :], "<u4").astype(np.int64))
    return np.concatenate(ranks), np.concatenate(marks)


def rank_bytes(ranks: np.ndarray) -> np.ndarray:
    """Packed ranks one after the other; their bytes order as the ranks do."""
    return np.ascontiguousarray(ranks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - RANK :]).ravel()


def again(distinct: pa.Array, count: np.ndarray) -> np.ndarray:
    return count > 1


def shared_ranks(distinct: pa.Array, count: np.ndarray) -> np.ndarray:
    """Of strings of packed ranks: how many leading ranks stand at another place too, as the neighbours in the order tell."""
    offsets, data = raw(distinct)
    ranks, first, n = data[: offsets[-1]].reshape(-1, RANK), offsets[:-1] // RANK, np.diff(offsets) // RANK
    lcp = np.zeros(max(len(n) - 1, 0), dtype=np.int64)
    alike, depth = np.arange(len(lcp)), 0
    while len(alike):
        alike = alike[(n[alike] > depth) & (n[alike + 1] > depth)]
        alike = alike[(ranks[first[alike] + depth] == ranks[first[alike + 1] + depth]).all(axis=1)]
        depth += 1
        lcp[alike] = depth
    near = np.maximum(np.append(lcp, 0), np.concatenate([[0], lcp]))[: len(n)]
    return np.where(count > 1, n, near)
