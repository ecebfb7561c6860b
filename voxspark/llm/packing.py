"""Packing of documents into training sequences, online in bounded space.

Each task tokenises its documents and packs them as they come.  It keeps at most
``windows`` open sequences.  Full sequences are cut from the front of a long
document; what is left goes into the open window that it fits best.  When none fits, the
fullest window is topped up with the document's next ids (or left short, if its room is
under ``least_cut``), emitted, and the rest tried again.  The windows that are open when
a task ends are merged in a last step over groups of tasks, so that padding is left
to one sequence a group.

Tokens are those of a byte-level BPE vocabulary in the form of the library
`tokenizers`; where its merges are in the order of its ids, the same ids are made by the
faster library tiktoken, but for texts that it can't cut (a million spaces in a row).

Results for odd inputs: a null or empty text is its end token alone; a text of any length is
encoded whole and cut where sequences end; rows with null or repeated ids are packed like
others; an empty table gives no rows; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..scratch import Scratch

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
#: How byte-level BPE cuts a text before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class PackParams:
    tokenizer: str = ""  # path of the vocabulary; empty: the public byte-level one
    size: int = 1024
    end_id: int = 0
    windows: int = 32
    least_cut: int = 16
    tasks_per_group: int = 64
    keep_ids: bool = False


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> array of ids, as the library tokenizers gives them without adding special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges, pre = spec["model"]["vocab"], spec["model"].get("merges", []), spec.get("pre_tokenizer") or {}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    in_order = all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    if in_order and plain and spec["model"]["type"] == "BPE":
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
        code = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(code[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
        encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> np.ndarray:
            try:
                return encoding.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its regular expressions give up on very long runs of white space
                return plain_encoder(path)(text)

        return encode
    return plain_encoder(path)


@lru_cache(maxsize=2)
def plain_encoder(path: str):
    """text -> array of ids by the library tokenizers itself."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


class Packer:
    """Open windows of one task; pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, params: PackParams, first_sequence: int):
        self.p, self.next, self.open, self.done = params, first_sequence, [], []

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            data = ids.astype("<u4").tobytes()
            self.done.append((doc_id, start, len(ids), zlib.crc32(data), total, self.next, offset, data if self.p.keep_ids else None))
            offset += len(ids)
        self.next += 1

    def add(self, doc_id, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        size, total = self.p.size, len(ids) if total is None else total
        while len(ids) >= size:
            self.emit([(doc_id, start, ids[:size], total)])
            ids, start = ids[size:], start + size
        while len(ids):
            fits = [w for w in self.open if w[0] >= len(ids)]
            if fits:
                window = min(fits, key=lambda w: w[0])
            elif len(self.open) < self.p.windows:
                window = [size, []]
                self.open.append(window)
            else:
                window = min(self.open, key=lambda w: w[0])
                if window[0] < self.p.least_cut:
                    self.open.remove(window)
                    self.emit(window[1])
                    continue
            part = ids[: window[0]]
            window[1].append((doc_id, start, part, total))
            window[0] -= len(part)
            ids, start = ids[len(part) :], start + len(part)
            if not window[0]:
                self.open.remove(window)
                self.emit(window[1])

    def taken(self) -> pd.DataFrame:
        out = pd.DataFrame(self.done, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]).astype({"doc_id": "Int64", "sequence_id": "Int64", "offset": "Int64"})
        self.done = []
        return out

    def leftovers(self) -> pd.DataFrame:
        rows = [(d, s, len(i), 0, t, None, None, i.astype("<u4").tobytes()) for w in self.open for d, s, i, t in w[1]]
        self.done = rows
        return self.taken()


def pack(docs: DataFrame, params: PackParams = PackParams(), scratch: Scratch | None = None) -> DataFrame:
    """Pieces of docs(doc_id, text): which ids of which document stand where in which sequence."""
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    path = params.tokenizer or default_tokenizer()

    def first(frames):
        packer, encode = Packer(params, TaskContext.get().partitionId() << 40), encoder(path)
        for pdf in frames:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = encode(text) if isinstance(text, str) else np.empty(0, dtype=np.uint32)
                packer.add(None if pd.isna(doc_id) else int(doc_id), np.append(ids, np.uint32(params.end_id)))
                if len(packer.done) >= 4096:
                    yield packer.taken()
        yield packer.taken()
        yield packer.leftovers()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = scratch.keep(source.mapInPandas(first, PIECES).withColumn("task", F.spark_partition_id()), "packed")
    group = F.floor(F.col("task") / params.tasks_per_group)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        # one window open: each piece goes on where the last one ended
        one = Packer(PackParams(size=params.size, windows=1, least_cut=1, keep_ids=params.keep_ids), (1 << 62) + (int(pdf["group"].iloc[0]) << 36))
        order = pdf.assign(none=pdf["doc_id"].isna()).sort_values(["none", "doc_id", "start", "task"])
        for row in order.itertuples(index=False):
            one.add(None if row.none else int(row.doc_id), np.frombuffer(row.ids, dtype="<u4"), int(row.start), int(row.doc_tokens))
        for window in one.open:
            one.emit(window[1])
        return one.taken()

    last = packed.where("sequence_id IS NULL").withColumn("group", group).groupBy("group").applyInPandas(merge, PIECES)
    return packed.where("sequence_id IS NOT NULL").drop("task").unionByName(last)
