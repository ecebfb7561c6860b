"""Removal of every byte that lies in a repeated string of ``window`` bytes.

The corpus is parsed prefix-free: a position whose next ``trigger_bytes`` bytes have a
rolling hash divisible by ``trigger_modulus`` begins a phrase, which ends with the trigger of the
next one, so that equal strings are cut at equal places and no phrase is a prefix of another.
What is repeated is then found from lexicographic ranks (``ranks.py``):

1. the dictionary: the distinct phrases are ranked;
2. the parse: its suffixes, as ranks of phrases, cut at the first phrase end after ``window``
   bytes ("blocks") or before a phrase that stands at one place only, are ranked; neighbours
   in that order tell how many leading phrases of each are repeated;
3. a whole region of repeated blocks is removed at once.  Only at its rims do the proper
   suffixes of phrases matter: windows that begin before a phrase are looked at if as many of its
   suffix's leading phrases are repeated as the window holds, if these and the bytes before them (in steps of
   eight) stand at two places by their hash, and if at one of the places a window is not in such a
   region; so are windows without a near phrase beginning (a word said again and again can have no
   trigger at all), each by its own hash;
4. the suffixes of dictionary phrases that such windows begin with, cut at ``head`` bytes, are
   ranked; windows whose suffix is repeated are then ordered by its rank, the ranks of
   the phrases that follow and the bytes of the last, unfinished one.

What is removed agrees in ranks and bytes; hashes only cut phrases and choose which windows are looked at.
Ranges of the orders are sorted in as many tasks as there are chunks, their limits come from a
sample of phrases (no more than 640,000).  No task or group holds a fixed share of the corpus, and a string that is
hot reaches its range once from each chunk.

Results for odd inputs: a null text is empty; texts under ``window`` bytes lose
nothing; a text of any length is looked at whole, in a chunk that ends with it; equal rows
repeat each other; an empty table gives no rows; all other columns pass through unchanged,
null ids too, but columns named like the results give way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .bytehash import U, Rolling, combine, mix, powers
from .chunks import SENT, corpus_bytes, expand, gather, n_chunks, pack_sent, reduce_keys, squeeze, unpack_reply, with_replies
from .ranks import RANK, again, in_order, pack_strings, rank_bytes, rank_strings, raw, shared_ranks, spread, strings, unpack_ranks
from ..scratch import Scratch

STORE = "chunk long, lens binary, data binary, extra binary"
PARSE = "chunk long, doc_lens binary, at binary, ranks binary, marks binary"
STEP = 8  # bytes before a phrase by which windows are classed
SPLIT = 24  # bytes of a range's limit; strings that agree in so many are in one range
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@dataclass(frozen=True)
class RepeatParams:
    window: int = 200
    trigger_bytes: int = 16
    trigger_modulus: int = 32
    stem: int = 50
    head: int = 32
    chunk_bytes: int = 2 << 20
    key_bits: int = 64  # of the keys that choose windows; fewer make keys agree by chance


def _triggers(data: np.ndarray, p: RepeatParams) -> np.ndarray:
    return np.flatnonzero(Rolling(data).windows(p.trigger_bytes) % U(p.trigger_modulus) == 0)


class _Parse:
    """Phrases of a chunk, their ranks and what is known of the places around them."""

    def __init__(self, lens: bytes, p: RepeatParams, data: bytes | None = None, at: np.ndarray | None = None):
        self.p = p
        self.bounds = np.concatenate([[0], np.cumsum(np.frombuffer(lens, dtype=np.int64))])
        self.data = None if data is None else np.frombuffer(data, dtype=np.uint8)
        if at is None:
            fires = _triggers(self.data, p)
            at = fires[fires + p.trigger_bytes <= self._doc_end(fires)]
        self.at, self.at_end = at, self._doc_end(at)
        #: a phrase that ends with its document has no next one
        self.closed = np.append(self.at_end[1:] == self.at_end[:-1], False)[: len(at)]
        self.follows = np.concatenate([[False], self.closed[:-1]])[: len(at)]

    def _doc_end(self, at: np.ndarray) -> np.ndarray:
        return self.bounds[np.searchsorted(self.bounds, at, "right")] if len(at) else at

    def phrases(self) -> pa.Array:
        end = np.where(self.closed, np.append(self.at[1:], 0)[: len(self.at)] + self.p.trigger_bytes, self.at_end)
        return strings(self.data, (self.at, end - self.at))

    def ranked(self, ranks: np.ndarray, marks: np.ndarray) -> None:
        self.ranks = ranks
        self.phrase_again = (marks & 1).astype(bool) & self.closed
        self.stem_again = (marks & 2).astype(bool) & (self.at + self.p.stem <= self.at_end)
        self.stem_rank = ranks - (marks >> 2).astype(U)

    def blocks(self) -> pa.Array:
        """The suffixes of the parse that begin with a repeated phrase, cut."""
        n, place = len(self.at), np.arange(len(self.at))
        to = np.searchsorted(self.at, self.at + self.p.window)
        last = np.minimum.accumulate(np.where(self.closed, n, place)[::-1])[::-1]  # where the document's last phrase begins
        bad = np.minimum.accumulate(np.where(self.phrase_again, n, place)[::-1])[::-1]
        self.block_to, self.whole = to, to <= last
        self.block_of = np.flatnonzero(self.phrase_again)
        cut = np.minimum(to, bad)[self.block_of]
        return strings(rank_bytes(self.ranks), (self.block_of * RANK, (cut - self.block_of) * RANK))

    def repeated_parts(self, shared: np.ndarray) -> None:
        """shared: how many leading phrases of each of blocks() are repeated."""
        self.shared = np.zeros(len(self.at), dtype=np.int64)
        self.shared[self.block_of] = shared
        self.block_again = self.whole & (self.shared >= self.block_to - np.arange(len(self.at)))

    def covered(self, i: np.ndarray) -> np.ndarray:
        """Which windows lie in regions of repeated blocks."""
        of = np.flatnonzero(self.block_again)
        if not len(of):
            return np.zeros(len(i), dtype=bool)
        start, reach = self.at[of], np.maximum.accumulate(self.at[self.block_to[of]] + self.p.trigger_bytes)
        last = np.append(start[1:] > reach[:-1], True)
        region = np.cumsum(np.concatenate([[0], last[:-1]]))
        at = np.searchsorted(start, i, "right") - 1
        return (at >= 0) & (reach[last][region[at]] >= i + self.p.window)

    def near_windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose phrases are repeated: first byte, the phrase that begins first in it, and how many end in it."""
        p, n = self.p, len(self.at)
        of = np.flatnonzero(self.stem_again)
        at, end = self.at[of], self.at_end[of]
        start = self.bounds[np.searchsorted(self.bounds, at, "right") - 1] if len(of) else at
        low = np.maximum(at - (p.window - p.stem), np.where(self.follows[of], self.at[of - 1] + 1, start))
        stop = of + self.shared[of] + 1  # the phrase that may not begin with its whole trigger in the window
        inside = (stop < n) & (self.at_end[np.minimum(stop, n - 1)] == end)
        high = np.minimum(at, np.where(inside, self.at[np.minimum(stop, n - 1)] + p.trigger_bytes - p.window - 1, at))
        high = np.minimum(high, end - p.window)
        lens = np.maximum(high - low + 1, 0)
        i, k = spread(low, lens), np.repeat(of, lens)
        return i, k, np.searchsorted(self.at, i + (p.window - p.trigger_bytes), "right") - 1 - k

    def classes(self, k: np.ndarray, q: np.ndarray, c: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Keys of q phrases from the k-th on, of its stem for none, and of the STEP * c bytes before them; then of far windows."""
        sums = np.zeros(len(self.at) + 1, dtype=U)
        np.cumsum(mix(self.ranks) * powers(len(self.at), "up"), out=sums[1:])
        run = np.where(q > 0, (sums[k + q] - sums[k]) * powers(len(self.at) + 1, "down")[k], self.stem_rank[k])
        hashed, cut = Rolling(self.data), U(64 - self.p.key_bits)
        near = combine(q.astype(U), run, hashed.slices(self.at[k] - STEP * c, self.at[k]))
        return np.concatenate([near, combine(hashed.slices(far, far + self.p.window))]) >> cut << cut

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all windows that may be ordered: distinct keys of their classes, where each run's key stands, each one's run, first bytes;
        phrases of the near ones, which come first."""
        (i, k, q), far = self.near_windows(), self.far_windows()
        c = (self.at[k] - i) // STEP
        new = np.ones(len(i), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (q[1:] != q[:-1]) | (c[1:] != c[:-1])
        keys, inverse = np.unique(self.classes(k[new], q[new], c[new], far), return_inverse=True)
        return keys, inverse, np.cumsum(np.concatenate([new, np.ones(len(far), dtype=bool)])) - 1, np.concatenate([i, far]), np.stack([k, q])

    def run_marks(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of classes; bit 0: a window of the class is not covered, bit 1: the class stands at two places."""
        keys, inverse, run, i, _ = self.runs()
        bare = np.bincount(inverse[run[~self.covered(i)]], minlength=len(keys)) > 0
        return keys, (bare | (np.bincount(inverse, minlength=len(keys)) > 1) << 1).astype(np.uint8)

    def far_windows(self) -> np.ndarray:
        """Windows in which no phrase begins near."""
        reach, window = self.p.window - self.p.stem, self.p.window
        docs = self.bounds[:-1][np.diff(self.bounds) > 0]
        start = np.concatenate([docs, self.at + 1])
        ahead = np.searchsorted(self.at, start)
        end = self._doc_end(np.concatenate([docs, self.at]))
        has = ahead < len(self.at)
        following = self.at[np.minimum(ahead, len(self.at) - 1)] if len(self.at) else start
        stop = np.minimum(end - window + 1, np.where(has & (following < end), following - reach, end))
        return spread(start, np.maximum(stop - start, 0))

    def opened(self, rim: np.ndarray) -> None:
        """Chooses the windows that are ordered; rim: which of the distinct keys of runs() stand at several places, one of them at a rim."""
        _, inverse, run, i, kq = self.runs()
        open_ = rim[inverse][run]
        near = open_[: kq.shape[1]]
        self.near, self.window_at = int(near.sum()), i[open_]
        self.window_of, self.window_run = kq[:, near]
        self.suffix_len = np.full(len(self.window_at), self.p.window)
        self.suffix_len[: self.near] = self.at[self.window_of] + self.p.trigger_bytes - self.window_at[: self.near]

    def suffixes(self) -> pa.Array:
        """The suffixes of phrases that the windows begin with, cut."""
        return strings(self.data, (self.window_at, np.minimum(self.suffix_len, self.p.head)))

    def windows(self, ranks: np.ndarray, chosen: np.ndarray) -> pa.Array:
        """The chosen windows: their suffix's rank and what was cut of it, ranks of phrases, the rest, and the number of ranks."""
        n, m, none = len(self.data), len(self.ranks), np.zeros(len(self.window_at) - self.near, dtype=np.int64)
        k, q = np.concatenate([self.window_of, none]), np.concatenate([self.window_run, none])
        rest = np.concatenate([self.at[self.window_of + self.window_run], none])
        end = np.concatenate([self.window_at[: self.near] + self.p.window, none])
        at, k, q, rest, end, lens = (x[chosen] for x in (self.window_at, k, q, rest, end, self.suffix_len))
        head, heads = np.minimum(lens, self.p.head), RANK * np.arange(len(at))
        counts = np.where(chosen < self.near, q, 0xFFFF).astype(">u4").view(np.uint8)
        buffer = np.concatenate([self.data, rank_bytes(self.ranks), rank_bytes(ranks[chosen]), counts])
        size = np.ones(len(at), dtype=np.int64)
        return strings(
            buffer, (n + RANK * m + heads, size * RANK), (at + head, lens - head), (n + RANK * k, RANK * q),
            (rest, end - rest), (n + RANK * (m + len(at)) + 4 * np.arange(len(at)), size * 4),
        )

    def removed(self, windows: np.ndarray) -> np.ndarray:
        change = np.zeros(len(self.data) + 1, dtype=np.int32)
        again = np.flatnonzero(self.block_again)
        np.add.at(change, self.at[again], 1)
        np.add.at(change, self.at[self.block_to[again]] + self.p.trigger_bytes, -1)
        np.add.at(change, windows, 1)
        np.add.at(change, windows + self.p.window, -1)
        return np.cumsum(change[:-1]) > 0

    def results(self, gone: np.ndarray):
        """Per document: removed spans and the bytes that stay."""
        turn = np.zeros(len(gone) + 1, dtype=bool)
        if len(gone):
            turn[0], turn[-1] = gone[0], gone[-1]
            turn[1:-1] = gone[1:] != gone[:-1]
            cut = self.bounds[1:-1]
            cut = cut[(cut > 0) & (cut < len(gone))]
            both = cut[gone[cut] & gone[cut - 1]]  # a run goes on in the next document
        else:
            both = np.empty(0, dtype=np.int64)
        both = np.unique(both)
        edges = np.sort(np.concatenate([np.flatnonzero(turn), both, both]))
        starts, ends = edges[::2], edges[1::2]
        stay = ~gone
        for i, j in zip(self.bounds[:-1], self.bounds[1:]):
            a, b = np.searchsorted(starts, i), np.searchsorted(starts, j)
            yield [{"start": int(s - i), "end": int(e - i)} for s, e in zip(starts[a:b], ends[a:b])], self.data[i:j][stay[i:j]].tobytes()


def _phrase_marks(stem: int):
    """Bit 0: the phrase stands at two places or more; bit 1: its first bytes do; from bit 2 on: how many places before it the first phrase with these stands."""

    def marks(distinct: pa.Array, count: np.ndarray) -> np.ndarray:
        lens = np.diff(raw(distinct)[0])
        first = pc.binary_slice(distinct, 0, stem)
        same = np.zeros(len(lens), dtype=bool)
        same[1:] = pc.equal(first[1:], first[:-1]).to_numpy(zero_copy_only=False) & (lens[1:] >= stem) & (lens[:-1] >= stem)
        group = np.cumsum(~same) - 1
        begin = np.flatnonzero(~same)[group]
        return (count > 1) | (np.bincount(group, count)[group] > 1) << 1 | (np.arange(len(lens)) - begin) << 2

    return marks


def _rims(inverse, values, n, keys):
    """Which classes stand at two places or more and have a window that is not covered."""
    bare, places = np.bincount(inverse, values & 1, n) > 0, np.bincount(inverse, 1 + (values >> 1), n)
    return (bare & (places > 1))[inverse].astype(np.uint8), None


def remove_repeats(docs: DataFrame, text: str = "text", params: RepeatParams = RepeatParams(), scratch: Scratch | None = None, readable: bool = False) -> DataFrame:
    """docs with n_bytes, spans (removed, in bytes of the text) and kept (the other bytes) in place of the text.

    readable: kept is a text, in which a character that lost some of its bytes is left out.
    """
    spark, p = docs.sparkSession, params
    scratch = scratch or Scratch(spark, "repeats")
    size = corpus_bytes(docs, text)
    buckets = n_chunks(size, 4 * p.chunk_bytes)
    rest = [c for c in docs.columns if c not in (text, "n_bytes", "spans", "kept")]
    out = T.StructType([docs.schema[c] for c in rest] + [T.StructField("n_bytes", T.LongType()), T.StructField("spans", SPANS), T.StructField("kept", T.StringType() if readable else T.BinaryType())])

    def encode(it):
        for chunk, pdf in gather(it, p.chunk_bytes, text):
            texts = list(pdf[text])
            table = pa.Table.from_pandas(pdf[rest], preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            yield pd.DataFrame([{"chunk": chunk, "lens": np.array([len(t) for t in texts], dtype=np.int64).tobytes(), "data": b"".join(texts), "extra": sink.getvalue().to_pybytes()}])

    store = scratch.keep_bucketed(docs.mapInPandas(encode, STORE), "chunk", buckets, "texts")

    def rows(it):
        for pdf in it:
            for k in range(len(pdf)):
                yield pdf.iloc[k]

    def packed(df: DataFrame, emit) -> DataFrame:
        def send(it):
            for row in rows(it):
                yield emit(row)

        return df.mapInPandas(send, SENT)

    # where ranges begin
    spared = max(1, size // p.chunk_bytes // 20_000)
    cut = min(SPLIT, p.stem)

    def sample(it):
        for row in rows(it):
            data = np.frombuffer(row["data"][: 1 << 15], dtype=np.uint8)
            at = _triggers(data, p)
            at = at[at + cut <= len(data)]
            at = at[:: len(at) // 32 + 1]
            yield pd.DataFrame({"found": [data[spread(at, np.full(len(at), cut))].tobytes()]})

    some = store.where(F.abs(F.hash("chunk")) % spared == 0).select("chunk", "data").mapInPandas(sample, "found binary")
    found = sorted({r.found[i : i + cut] for r in some.collect() for i in range(0, len(r.found), cut)})
    splits = [found[len(found) * b // buckets] for b in range(1, buckets)] if found else [b"\xff"] * (buckets - 1)

    def send_phrases(row):
        c = _Parse(row["lens"], p, row["data"])
        return pack_strings("phrases", int(row["chunk"]), c.phrases(), splits)[0]

    phrases = scratch.keep(rank_strings(packed(store, send_phrases), _phrase_marks(p.stem)), "phrases")

    def parse(it):
        for row in rows(it):
            c = _Parse(row["lens"], p, row["data"])
            ranks, marks = unpack_ranks(row["phrases"])
            place = in_order(c.phrases())[1]
            yield pd.DataFrame([{"chunk": row["chunk"], "doc_lens": row["lens"], "at": squeeze(np.diff(c.at, prepend=0)), "ranks": squeeze(ranks[place]), "marks": squeeze(marks[place])}])

    parsed = scratch.keep_bucketed(with_replies(store.select("chunk", "lens", "data"), buckets, phrases=phrases).mapInPandas(parse, PARSE), "chunk", buckets, "parse")
    scratch.drop(phrases)

    def known(row) -> _Parse:
        c = _Parse(row["doc_lens"], p, row["data"] if "data" in row else None, np.cumsum(expand(row["at"], np.int64)))
        c.ranked(expand(row["ranks"], U), expand(row["marks"], np.int64))
        return c

    def send_blocks(row):
        return pack_strings("blocks", int(row["chunk"]), known(row).blocks(), buckets)[0]

    blocks = scratch.keep(rank_strings(packed(parsed, send_blocks), shared_ranks), "blocks")

    def joined(row) -> _Parse:
        c = known(row)
        place = in_order(c.blocks())[1]
        c.repeated_parts(unpack_ranks(row["blocks"])[1][place])
        return c

    def send_rims(row):
        c = joined(row)
        return pack_sent("rims", int(row["chunk"]), *c.run_marks(), buckets)

    both = store.join(parsed.hint("merge"), "chunk")
    rims = scratch.keep(reduce_keys(packed(with_replies(both, buckets, blocks=blocks), send_rims), {"rims": _rims}, {"rims": "u1"}), "rims")

    def opened(row) -> _Parse:
        c = joined(row)
        c.opened(unpack_reply(row["rims"], "u1").astype(bool))
        return c

    def send_suffixes(row):
        return pack_strings("suffixes", int(row["chunk"]), opened(row).suffixes(), splits)[0]

    suffixes = scratch.keep(rank_strings(packed(with_replies(both, buckets, blocks=blocks, rims=rims), send_suffixes), again), "suffixes")

    def chosen(row) -> tuple[_Parse, np.ndarray, pa.Array]:
        """The windows whose suffix is repeated."""
        c = opened(row)
        ranks, marks = unpack_ranks(row["suffixes"])
        place = in_order(c.suffixes())[1]
        which = np.flatnonzero(marks[place] > 0)
        return c, c.window_at[which], c.windows(ranks[place], which)

    def send_windows(row):
        return pack_strings("windows", int(row["chunk"]), chosen(row)[2], buckets)[0]

    windows = scratch.keep(rank_strings(packed(with_replies(both, buckets, blocks=blocks, rims=rims, suffixes=suffixes), send_windows), again), "windows")

    def finish(it):
        for row in rows(it):
            c, at, held = chosen(row)
            gone = c.removed(at[unpack_ranks(row["windows"])[1][in_order(held)[1]] > 0])
            pdf = pa.ipc.open_stream(row["extra"]).read_pandas()
            spans, kept = zip(*c.results(gone))
            kept = [k.decode("utf-8", "ignore") for k in kept] if readable else list(kept)
            yield pdf.assign(n_bytes=np.diff(c.bounds), spans=list(spans), kept=kept)[out.names]

    return with_replies(both, buckets, blocks=blocks, rims=rims, suffixes=suffixes, windows=windows).mapInPandas(finish, out)


def digest(result: DataFrame) -> DataFrame:
    """What was removed, in numbers, and the SHA-256 of what stays."""
    return result.select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
