"""Removal of repeated lines by an index that takes documents in and out again.

A line's key is the line without white space at both ends and with A-Z in lower case;
keys of at least ``least`` characters count.  A key that several documents hold keeps its
lines only in the document with the smallest id.

The index counts references at two levels.  A *chunk* (some MB of documents) holds its
lines' keys, and for each the number of its documents and the smallest id among them.
*Shards* (ranges of keys) hold one entry (key, chunk, number, smallest id) for each chunk
that has the key: the exact reference counts.  A line that stands in every document thus has an
entry a chunk, not one a document.  In front of a shard's entries stands a cuckoo
filter of its keys: keys that come in and are not in the filter are new for sure and are added
without a look at the entries; only those that the filter knows are compared with them.

Documents are taken out by their ids: the counts of their chunks go down, entries without documents go,
and a key without entries leaves the filter, so the lines that a deleted document had held come back in
the next document that has them.  Deleted rows are marked, the chunks that hold them stay as written.

Keys are 128-bit BLAKE2b digests: among 10**13 different lines the chance that any two
agree is under 1e-12.

Results for odd inputs: a null or empty text is one empty line and loses nothing; a text or
line of any length is taken whole; rows that share an id are taken in and out together and lose no line
to each other; rows with null ids come after all others, as if they shared one id, and
can't be taken out; an id of 2**63 - 1 counts as null; an empty table gives no rows; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .chunks import corpus_bytes, expand, gather, squeeze
from .cuckoo import KEY, CuckooFilter
from ..scratch import Scratch

STORE = "chunk long, docs long, entries long, ids binary, lens binary, data binary, line_key binary, keys binary, n binary, first binary"
SHARD = "shard long, filter binary, keys binary, chunk binary, n binary, first binary"
SENT = "shard long, sent long, keys binary, chunk binary, n binary, first binary"
REPLY = "chunk long, keys binary, first binary"
RESULT = "doc_id long, n_lines long, n_dropped long, kept string"
NO_ID = np.iinfo(np.int64).max
BLANK = b" \t\n\v\f\r"


@dataclass(frozen=True)
class LineParams:
    least: int = 10
    chunk_bytes: int = 8 << 20
    shard_bytes: int = 32 << 20  # of text for each shard
    least_shards: int = 16
    message: int = 64  # keys of a message, on average at least


def line_key(line: bytes, least: int) -> bytes | None:
    line = line.strip(BLANK)
    if len(line) < least or (len(line) < 4 * least and len(line.decode("utf-8", "surrogatepass")) < least):
        return None
    return blake2b(line.lower(), digest_size=16).digest()


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of keys; shards is a power of two."""
    high = np.ascontiguousarray(keys).view(">u8").reshape(-1, 2)[:, 0].astype(np.uint64)
    return (high >> np.uint64(64 - shards.bit_length() + 1)).astype(np.int64) if shards > 1 else np.zeros(len(keys), dtype=np.int64)


def _keys(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=KEY)


def _references(ids: np.ndarray, bounds: np.ndarray, line_key: np.ndarray, n_keys: int, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each key the number of documents that hold it and the smallest id among them."""
    doc = np.repeat(np.arange(len(ids)), np.diff(bounds))
    use = line_key >= 0
    if live is not None:
        use = use & live[doc]
    pairs = np.unique(line_key[use].astype(np.int64) * max(1, len(ids)) + doc[use])
    key, doc = pairs // max(1, len(ids)), pairs % max(1, len(ids))
    first = np.full(n_keys, NO_ID)
    np.minimum.at(first, key, ids[doc])
    return np.bincount(key, minlength=n_keys), first


class _Chunk:
    """A stored chunk of documents."""

    def __init__(self, row):
        self.id, self.ids = int(row["chunk"]), expand(row["ids"], "i8")
        self.bounds = np.concatenate([[0], np.cumsum(expand(row["lens"], "i8"))])  # of the documents' lines
        self.line_key, self.keys = expand(row["line_key"], "i4"), _keys(row["keys"])

    def references(self, live: np.ndarray | None = None):
        return _references(self.ids, self.bounds, self.line_key, len(self.keys), live)

    def live(self, dead) -> np.ndarray:
        """Rows whose id is not among the deleted ones."""
        gone = np.array(dead if dead is not None else (), dtype=np.int64)
        return ~np.isin(self.ids, gone) | (self.ids == NO_ID)


def _encode(p: LineParams, batch: int):
    def encode(frames):
        for chunk, pdf in gather(frames, p.chunk_bytes, row_bytes=64):
            known: dict[bytes, int] = {}
            lens, of = [], []
            for text in pdf["text"]:
                lines = text.split(b"\n")
                lens.append(len(lines))
                of.extend(-1 if (k := line_key(line, p.least)) is None else known.setdefault(k, len(known)) for line in lines)
            ids = pdf["doc_id"].astype("Int64").fillna(NO_ID).to_numpy(dtype=np.int64)
            keys, of = np.frombuffer(b"".join(known), dtype=KEY), np.array(of, dtype=np.int32)
            order = np.argsort(keys)
            place = np.empty(len(keys), dtype=np.int32)
            place[order] = np.arange(len(keys), dtype=np.int32)
            of[of >= 0] = place[of[of >= 0]]
            n, first = _references(ids, np.concatenate([[0], np.cumsum(lens)]), of, len(keys))
            yield pd.DataFrame([{
                "chunk": (batch << 50) + chunk, "docs": len(pdf), "entries": len(keys), "ids": squeeze(ids), "lens": squeeze(np.array(lens, dtype=np.int64)), "data": b"\n".join(pdf["text"]),
                "line_key": squeeze(of), "keys": keys[order].tobytes(), "n": squeeze(n), "first": squeeze(first),
            }])

    return encode


def _rows(frames):
    for pdf in frames:
        for k in range(len(pdf)):
            yield pdf.iloc[k]


def _send(entries, shards: int, p: LineParams):
    """Messages for the shards out of (chunk, keys, n, first) of many chunks."""

    def messages(held, sent):
        keys, chunk, n, first = (np.concatenate(x) for x in zip(*held))
        shard = shard_of(keys, shards)
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.diff(shard[order])) + 1
        rows = [(int(shard[i[0]]), sent, keys[i].tobytes(), squeeze(chunk[i]), squeeze(n[i]), squeeze(first[i])) for i in np.split(order, cut) if len(i)]
        return pd.DataFrame(rows, columns=["shard", "sent", "keys", "chunk", "n", "first"])

    def send(frames):
        held, size, sent = [], 0, 0
        for chunk, keys, n, first in entries(frames):
            if len(keys):
                held.append((keys, np.full(len(keys), chunk, dtype=np.int64), n, first))
                size += len(keys)
            if size >= p.message * shards:
                yield messages(held, sent)
                held, size, sent = [], 0, sent + 1
        if held:
            yield messages(held, sent)

    return send


class Shard:
    """The exact reference counts of a range of keys, and their filter."""

    def __init__(self, row=None):
        if row is None:
            self.filter, self.keys = CuckooFilter(), np.empty(0, dtype=KEY)
            self.chunk, self.n, self.first = (np.empty(0, dtype=np.int64) for _ in range(3))
        else:
            self.filter, self.keys = CuckooFilter.from_bytes(row["filter"]), _keys(row["keys"])
            self.chunk, self.n, self.first = (expand(row[c], "i8") for c in ("chunk", "n", "first"))

    def frame(self, shard: int) -> pd.DataFrame:
        return pd.DataFrame([{"shard": shard, "filter": self.filter.to_bytes(), "keys": self.keys.tobytes(), "chunk": squeeze(self.chunk), "n": squeeze(self.n), "first": squeeze(self.first)}])

    def insert(self, messages: list[tuple]) -> int:
        """Add entries of new chunks; how many of them were compared with entries."""
        more = sum(len(m[0]) for m in messages)
        if not self.filter.room(more):
            known = np.unique(self.keys)
            self.filter = CuckooFilter(2 * (len(known) + more))
            self.filter.insert(known)
        new, asked = [self.keys], []
        for keys, *_ in messages:
            distinct, at = np.unique(keys, return_index=True)
            seen = self.filter.contains(distinct)
            self.filter.insert(distinct[~seen])
            new.append(distinct[~seen])
            asked.append(distinct[seen])
        asked = np.unique(np.concatenate([*asked, np.empty(0, dtype=KEY)]))
        if len(asked):  # those that the filter took for known: are they?
            there = np.zeros(len(asked), dtype=bool)
            for known in new:
                at = np.minimum(np.searchsorted(asked, known), len(asked) - 1)
                there[at[asked[at] == known]] = True
            self.filter.insert(asked[~there])
        self.keys = np.concatenate([self.keys, *(m[0] for m in messages)])
        self.chunk, self.n, self.first = (np.concatenate([mine, *(m[k] for m in messages)]) for k, mine in enumerate((self.chunk, self.n, self.first), 1))
        return len(asked)

    def update(self, messages: list[tuple]) -> None:
        """New counts of entries that exist; those of zero go, and keys without entries leave the filter."""
        at = np.lexsort((self.chunk, self.keys))
        self.keys, self.chunk, self.n, self.first = self.keys[at], self.chunk[at], self.n[at], self.first[at]
        place = {}
        for keys, chunk, n, first in messages:
            low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            for i, (a, b) in enumerate(zip(low, high)):
                place[a + int(np.searchsorted(self.chunk[a:b], chunk[i]))] = (n[i], first[i])
        for k, (n, first) in place.items():
            self.n[k], self.first[k] = n, first
        before = np.unique(self.keys)
        stay = self.n > 0
        self.keys, self.chunk, self.n, self.first = self.keys[stay], self.chunk[stay], self.n[stay], self.first[stay]
        self.filter.delete(np.setdiff1d(before, self.keys))

    def split(self, shards: int):
        """The same entries dealt to more shards."""
        shard = shard_of(self.keys, shards)
        for s in np.unique(shard):
            part, mine = Shard(), shard == s
            part.keys, part.chunk, part.n, part.first = self.keys[mine], self.chunk[mine], self.n[mine], self.first[mine]
            known = np.unique(part.keys)
            part.filter = CuckooFilter(2 * len(known))
            part.filter.insert(known)
            yield int(s), part

    def replies(self) -> pd.DataFrame:
        """(chunk, keys, first) of keys that an earlier document of another chunk holds."""
        order = np.argsort(self.keys, kind="stable")
        ranked = self.keys[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = ranked[1:] != ranked[:-1]
        of = np.cumsum(new) - 1
        low = np.minimum.reduceat(self.first[order], np.flatnonzero(new)) if len(order) else self.first
        late = np.flatnonzero(self.first[order] > low[of]) if len(order) else order
        chunk, keys, first = self.chunk[order][late], ranked[late], low[of[late]] if len(late) else low[:0]
        by = np.argsort(chunk, kind="stable")
        cut = np.flatnonzero(np.diff(chunk[by])) + 1
        rows = [(int(chunk[i[0]]), keys[i].tobytes(), squeeze(first[i])) for i in np.split(by, cut) if len(i)]
        return pd.DataFrame(rows, columns=["chunk", "keys", "first"])


def _messages(pdf: pd.DataFrame) -> list[tuple]:
    return [(_keys(m["keys"]), expand(m["chunk"], "i8"), expand(m["n"], "i8"), expand(m["first"], "i8")) for m in pdf.to_dict("records")]


@dataclass(frozen=True)
class LineIndex:
    """One state of the index; :meth:`insert` and :meth:`delete` give new states and leave this one as it is."""

    spark: SparkSession
    scratch: Scratch
    params: LineParams = LineParams()
    stores: tuple[DataFrame, ...] = ()  # chunks, one table an insertion
    buckets: tuple[int, ...] = ()
    shards: DataFrame | None = None
    n_shards: int = 0
    bytes: int = 0
    dead: DataFrame | None = None  # (chunk, dead): deleted ids of a chunk

    @classmethod
    def empty(cls, spark: SparkSession, params: LineParams = LineParams(), scratch: Scratch | None = None) -> LineIndex:
        return cls(spark, scratch or Scratch(spark, "lines"), params)

    def _merged(self, sent: DataFrame, n_shards: int, change) -> DataFrame:
        """Shards with messages taken in; the shards stay where they are, the messages move."""
        if self.shards is None:

            def fresh(pdf: pd.DataFrame) -> pd.DataFrame:
                shard = Shard()
                change(shard, _messages(pdf))
                return shard.frame(int(pdf["shard"].iloc[0]))

            out = sent.repartition(n_shards, "shard").groupBy("shard").applyInPandas(fresh, SHARD)
        else:

            def merge(mine: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
                shard = Shard(mine.iloc[0] if len(mine) else None)
                if len(pdf):
                    change(shard, _messages(pdf))
                return shard.frame(int((mine if len(mine) else pdf)["shard"].iloc[0]))

            moved = sent.repartition(n_shards, "shard")
            out = self.shards.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(merge, SHARD)
        return self.scratch.keep_bucketed(out, "shard", n_shards, "shards")

    def _grown(self, n_shards: int) -> LineIndex:
        """This index with more shards."""
        if self.shards is None or n_shards == self.n_shards:
            return replace(self, n_shards=n_shards)

        def split(frames):
            for row in _rows(frames):
                for shard, part in Shard(row).split(n_shards):
                    yield part.frame(shard)

        return replace(self, n_shards=n_shards, shards=self.scratch.keep_bucketed(self.shards.mapInPandas(split, SHARD), "shard", n_shards, "shards"))

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
        """The index with these documents taken in."""
        p = self.params
        docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        size = corpus_bytes(docs)
        buckets = max(16, math.ceil(size / (4 * p.chunk_bytes)))
        store = self.scratch.keep_bucketed(docs.mapInPandas(_encode(p, len(self.stores)), STORE), "chunk", buckets, "lines")
        n_shards = max(p.least_shards, self.n_shards, 1 << max(0, math.ceil(math.log2(max(1, (self.bytes + size) / p.shard_bytes)))))
        grown = self._grown(n_shards)

        def entries(frames):
            for row in _rows(frames):
                yield int(row["chunk"]), _keys(row["keys"]), expand(row["n"], "i8"), expand(row["first"], "i8")

        sent = store.select("chunk", "keys", "n", "first").mapInPandas(_send(entries, n_shards, p), SENT)
        shards = grown._merged(sent, n_shards, Shard.insert)
        return replace(grown, stores=(*self.stores, store), buckets=(*self.buckets, buckets), shards=shards, bytes=self.bytes + size)

    def _living(self, store: DataFrame) -> DataFrame:
        return store.withColumn("dead", F.lit(None).cast("array<long>")) if self.dead is None else store.join(self.dead, "chunk", "left")

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> LineIndex:
        """The index without the documents of these ids; ids that it does not hold change nothing."""
        p = self.params
        ids = ids.select(F.col(doc_id).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()

        def held(frames):
            for row in _rows(frames):
                have = expand(row["ids"], "i8")
                yield pd.DataFrame({"chunk": int(row["chunk"]), "doc_id": np.unique(have[have != NO_ID])})

        found = None
        for store in self.stores:
            part = store.select("chunk", "ids").mapInPandas(held, "chunk long, doc_id long").join(ids, "doc_id")
            found = part if found is None else found.unionByName(part)
        if found is None:
            return self
        # a chunk holds a bounded number of documents
        going = self.scratch.keep(found.groupBy("chunk").agg(F.collect_set("doc_id").alias("going")), "going")

        def entries(frames):
            for row in _rows(frames):
                c = _Chunk(row)
                live = c.live(row["dead"])
                (n, first), (n_then, first_then) = c.references(live), c.references(live & c.live(row["going"]))
                changed = (n != n_then) | (first != first_then)
                yield c.id, c.keys[changed], n_then[changed], first_then[changed]

        sent = None
        for store in self.stores:
            part = self._living(store.select("chunk", "ids", "lens", "line_key", "keys")).join(going, "chunk").mapInPandas(_send(entries, self.n_shards, p), SENT)
            sent = part if sent is None else sent.unionByName(part)
        shards = self._merged(sent, self.n_shards, Shard.update)
        dead = going.withColumnRenamed("going", "dead")
        if self.dead is not None:
            dead = self.dead.unionByName(dead).groupBy("chunk").agg(F.array_distinct(F.flatten(F.collect_list("dead"))).alias("dead"))
        return replace(self, shards=shards, dead=self.scratch.keep(dead, "dead"))

    def deduplicated(self) -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept): each document of the index without lines that an earlier one holds."""
        if self.shards is None:
            return self.spark.createDataFrame([], RESULT)

        def reply(frames):
            for row in _rows(frames):
                yield Shard(row).replies()

        replies = self.scratch.keep(self.shards.mapInPandas(reply, REPLY), "replies")

        def result(frames):
            for row in _rows(frames):
                c = _Chunk(row)
                live = c.live(row["dead"])
                _, first = c.references(live)
                for r in row["replies"] if row["replies"] is not None else ():
                    at = np.searchsorted(c.keys, _keys(r["keys"]))
                    first[at] = np.minimum(first[at], expand(r["first"], "i8"))
                owner = np.repeat(c.ids, np.diff(c.bounds))
                drop = c.line_key >= 0
                drop[drop] = first[c.line_key[drop]] < owner[drop]
                lines = row["data"].split(b"\n")
                out = []
                for k, (a, b) in enumerate(zip(c.bounds[:-1], c.bounds[1:])):
                    if live[k]:
                        gone = int(drop[a:b].sum())
                        kept = lines[a:b] if not gone else [lines[i] for i in range(a, b) if not drop[i]]
                        out.append((None if c.ids[k] == NO_ID else int(c.ids[k]), b - a, gone, b"\n".join(kept).decode("utf-8", "surrogatepass")))
                for i in range(0, len(out), 4096):
                    yield pd.DataFrame(out[i : i + 4096], columns=["doc_id", "n_lines", "n_dropped", "kept"]).astype({"doc_id": "Int64"})

        out = None
        for store, buckets in zip(self.stores, self.buckets):
            got = replies.repartition(buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("keys", "first")).alias("replies"))
            part = self._living(store.join(got, "chunk", "left")).mapInPandas(result, RESULT)
            out = part if out is None else out.unionByName(part)
        return out


def digest(result: DataFrame) -> DataFrame:
    """How many lines each document had and lost, and the SHA-256 of what stays."""
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: LineParams = LineParams(), scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of all documents, through an index of them alone."""
    return LineIndex.empty(docs.sparkSession, params, scratch).insert(docs, doc_id, text).deduplicated()
