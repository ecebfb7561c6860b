"""SentencePiece encoding and decoding by streaming Viterbi.

Encoding finds the segmentation of a text into pieces with the largest sum of scores.
The search goes over the text once and keeps the scores of the last boundaries only, as
many as the longest piece has characters.  A boundary that leaves this window without
a path that goes on from it is dropped, with what led to it alone; as soon as all paths
that are left take the same next boundary, the piece up to it is final and its ids are
given out.

No piece goes over the beginning of a word, nor over a character that stands in no longer
piece, so that all paths converge there.  The stretches between such places are streams of
their own.  Streams of up to ``ABREAST`` characters go abreast, the same steps over arrays,
longer ones one after another; the ids of frequent words are remembered.

Ties go to the longer last piece.  A character without a piece of its own costs the lowest
score less 10 and is given as its bytes (or as the unknown id, without byte pieces).

Results for odd inputs: null and empty texts have no ids; a text that contains U+2581
decodes to a space there; a text of any length is encoded whole; equal rows give equal
ids; an empty table gives no rows; other columns pass through unchanged, but ones named
like the results give way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .bytehash import BASE, U, mix, powers

SPACE_MARK = "▁"
ABREAST = 40  # characters of the longest streams that go abreast
KEPT_WORDS = 400_000


@dataclass
class Pieces:
    """A vocabulary: what can be matched, and what each id stands for."""

    by_text: dict[str, tuple[int, float]]
    shown: list[bytes]
    byte_ids: list[int]
    unknown_id: int
    unknown_score: float
    longest: int

    def __post_init__(self):
        self.free = not any(SPACE_MARK in t.lstrip(SPACE_MARK) for t in self.by_text)
        joined = {c for t in self.by_text if len(t) > 1 for c in t}
        alone = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in joined)
        solo = f"[{alone}]|" if alone else ""
        rest = f"[^{SPACE_MARK}{alone}]"
        self.words = re.compile(f"{solo}{SPACE_MARK}+{rest}*|{rest}+", re.S)
        texts = list(self.by_text)
        keys = np.array([text_key(t) for t in texts], dtype=U)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a key")
        self.keys, self.ids = keys, np.array([self.by_text[t][0] for t in texts], dtype=np.int64)
        self.scores = np.array([self.by_text[t][1] for t in texts], dtype=np.float64)
        self.slot = np.full(1 << 20, -1, dtype=np.int32)
        home = (keys >> U(44)).astype(np.int64)
        self.slot[home[::-1]] = np.arange(len(keys))[::-1]
        late = np.flatnonzero(self.slot[home] != np.arange(len(keys)))  # second of two pieces with one home
        late = late[np.argsort(keys[late])]
        self.late_keys, self.late = keys[late], late

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of the piece with each key, or -1."""
        at = self.slot[(keys >> U(44)).astype(np.int64)].astype(np.int64)
        taken = at >= 0
        wrong = taken & (self.keys[at] != keys)
        at[wrong] = -1
        if len(self.late) and wrong.any():
            look = np.flatnonzero(wrong)
            k = np.minimum(np.searchsorted(self.late_keys, keys[look]), len(self.late) - 1)
            hit = self.late_keys[k] == keys[look]
            at[look[hit]] = self.late[k[hit]]
        return at

    def unknown(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown_id]


def _char_keys(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(U) + U(0x1F123BB5))


def text_key(text: str) -> int:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    total = (_char_keys(codes) * powers(len(codes), "up")).sum(dtype=U) if len(codes) else U(0)
    return int(mix(np.array([total + U(len(codes))]))[0])


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    by_text, shown, bytes_, scores = {}, [], {}, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_[int(piece[3:5], 16)] = i
            shown.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            shown.append(b" \xe2\x81\x87 " if sp.is_unknown(i) else b"")
        else:
            by_text[piece] = (i, float(sp.get_score(i)))
            scores.append(float(sp.get_score(i)))
            shown.append(piece.replace(SPACE_MARK, " ").encode())
    low = min(s for s in scores if s > -1e8)  # scores below mark pieces that are never chosen
    return Pieces(by_text, shown, [bytes_[b] for b in range(256)] if len(bytes_) == 256 else [], sp.unk_id(), low - 10, max(map(len, by_text)))


def stream(chars: Iterator[str], pieces: Pieces) -> Iterator[tuple[list[int], float]]:
    """Ids, and their score, of each piece of the text as soon as it is final."""
    m, window = pieces.longest, ""  # the last characters, as many as the longest piece has
    best, back, ids = {0: 0.0}, {}, {}  # of the boundaries that are left
    kids, kid = {0: 0}, {0: 0}  # how many boundaries go back to each, and the sum of these
    end = base = 0  # base: the last final boundary

    def leave(b: int) -> None:
        """Drop a boundary that no path goes on from, and what led to it alone."""
        while b > base and b < end - m + 1 and not kids[b]:
            del kids[b], kid[b], ids[b]
            b, gone = back.pop(b), b
            kids[b] -= 1
            kid[b] -= gone

    for c in chars:
        window = (window + c)[-m:]
        end += 1
        top = None
        for s in range(max(0, end - m), end):  # from the longest piece to the shortest
            known = pieces.by_text.get(window[s - end :])
            if known is None and s == end - 1:
                known = (pieces.unknown(c), pieces.unknown_score)
            if known is not None and (top is None or best[s] + known[1] > top[0]):
                top = (best[s] + known[1], s, known[0])
        best[end], s, found = top
        back[end], ids[end] = s, found if isinstance(found, list) else [found]
        kids[end] = kid[end] = 0
        kids[s] += 1
        kid[s] += end
        if end >= m:
            leave(end - m)
        while base < end - m + 1 and kids[base] == 1:
            after = kid[base]
            yield ids.pop(after), best[after] - best.pop(base)
            del back[after], kids[base], kid[base]
            base = after
            for b in [b for b in best if b < min(base, end - m + 1)]:
                del best[b]
    rest = []
    at = end
    while at > base:
        rest.append(at)
        at = back[at]
    for b in reversed(rest):
        yield ids[b], best[b] - best[at]
        at = b


def stream_many(words: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Ids of short streams, one after another, how many each has, its score, and how many pieces were final before their stream's end.

    The same search as :func:`stream`, all streams abreast.
    """
    n, m, size = len(words), pieces.longest, np.array([len(w) for w in words])
    order = np.argsort(-size, kind="stable")
    lens, width = size[order], int(size.max())
    codes = np.zeros((width, n), dtype=np.uint32)  # a row for each position
    flat = np.frombuffer("".join(words[k] for k in order).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes[np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens), np.repeat(np.arange(n), lens)] = flat
    ring = m + 1  # boundaries that a piece can still begin at, and the one that is being found
    char = np.zeros((m, n), dtype=U)
    best = np.full((ring, n), -np.inf)
    best[0] = 0
    back, piece = np.zeros((width + 1, n), dtype=np.int16), np.full((width + 1, n), -1, dtype=np.int32)
    kids, kid = np.zeros((width + 1, n), dtype=np.int16), np.zeros((width + 1, n), dtype=np.int32)
    base, early = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    out_piece, out_at = np.zeros((width, n), dtype=np.int32), np.zeros((width, n), dtype=np.int16)
    for end in range(1, width + 1):
        live = int(np.searchsorted(-lens, -end, "right"))  # streams of this length or more
        char[(end - 1) % m, :live] = _char_keys(codes[end - 1, :live])
        score, from_, by = np.full(live, -np.inf), np.zeros(live, dtype=np.int16), np.full(live, -1, dtype=np.int32)
        start = max(0, end - m)
        tails = []  # hashes of the last 1, 2, ... characters
        total = np.zeros(live, dtype=U)
        for length in range(1, end - start + 1):
            total = total * BASE + char[(end - length) % m, :live]
            tails.append(total)
        for s in range(start, end):  # from the longest piece to the shortest
            at = pieces.find(mix(tails[end - s - 1] + U(end - s)))
            new = np.where(at >= 0, pieces.scores[at], pieces.unknown_score if s == end - 1 else -np.inf) + best[s % ring, :live]
            better = new > score
            score[better], from_[better], by[better] = new[better], s, at[better]
        best[end % ring, :live] = score
        back[end, :live], piece[end, :live] = from_, by
        column = np.arange(live)
        kids[from_, column] += 1
        kid[from_, column] += end
        if end < m:
            continue
        gone, b = column, np.full(live, end - m)  # what leaves the window without a path that goes on
        while len(gone):
            dead = (b > base[gone]) & (b < end - m + 1) & (kids[b, gone] == 0)
            gone, b = gone[dead], b[dead]
            to = back[b, gone].astype(np.int64)
            kids[to, gone] -= 1
            kid[to, gone] -= b.astype(np.int32)
            b = to
        sure = column
        while len(sure):  # all paths go on to the same boundary
            sure = sure[(base[sure] < end - m + 1) & (kids[base[sure], sure] == 1)]
            to = kid[base[sure], sure].astype(np.int64)
            out_piece[early[sure], sure], out_at[early[sure], sure] = piece[to, sure], to
            early[sure] += 1
            base[sure] = to
    # at a stream's end its last boundary is the only one left
    many, at, column = early.copy(), lens.copy(), np.arange(n)
    rest_piece, rest_at = [], []
    while len(column):
        column = column[at[column] > base[column]]
        rest_piece.append((column, piece[at[column], column], at[column]))
        many[column] += 1
        at[column] = back[at[column], column]
    total = np.empty(n)
    score_at = best[lens % ring, np.arange(n)]
    total[order] = score_at
    filled = early.copy()
    for column, p, where in reversed(rest_piece):
        out_piece[filled[column], column], out_at[filled[column], column] = p, where
        filled[column] += 1
    # in the order of the words
    use = np.empty(n, dtype=np.int64)
    use[order] = np.arange(n)
    many, out_piece, out_at = many[use], out_piece[:, use].T, out_at[:, use].T
    inside = np.arange(width)[None, :] < many[:, None]
    found, where, of = out_piece[inside], out_at[inside], np.repeat(np.arange(n), many)
    ids, counts = np.where(found >= 0, pieces.ids[found], 0).astype(np.int32), many.astype(np.int64)
    unknown = np.flatnonzero(found < 0)
    if len(unknown):
        parts = [pieces.unknown(words[of[u]][where[u] - 1]) for u in unknown]
        extra = np.array([len(p) for p in parts])
        width_of = np.ones(len(ids), dtype=np.int64)
        width_of[unknown] = extra
        begin = np.cumsum(width_of) - width_of
        ids = np.repeat(ids, width_of)
        ids[np.repeat(begin[unknown], extra) + np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra)] = [i for p in parts for i in p]
        counts = np.bincount(of, width_of, n).astype(np.int64)
    return ids, counts, total, int(early.sum())


class Encoder:
    """Ids of texts, with what is known of the words so far."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.streamed = self.early = 0  # streams searched, pieces that were final before their stream's end
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size, self.score = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def learn(self, words: list[str]) -> None:
        """Search words that are not known yet."""
        short, long_ = [w for w in words if len(w) <= ABREAST], [w for w in words if len(w) > ABREAST]
        ids, sizes, scores = [self.flat], [self.size], [self.score]
        for k in range(0, len(short), 8192):
            i, n, s, early = stream_many(short[k : k + 8192], self.pieces)
            ids.append(i)
            sizes.append(n)
            scores.append(s)
            self.early += early
        for w in long_:
            parts = list(stream(iter(w), self.pieces))
            ids.append(np.array([i for p, _ in parts for i in p], dtype=np.int32))
            sizes.append(np.array([len(ids[-1])]))
            scores.append(np.array([sum(s for _, s in parts)]))
        self.streamed += len(words)
        self.known.update(zip([*short, *long_], range(len(self.known), len(self.known) + len(words))))
        self.flat, self.size, self.score = np.concatenate(ids), np.concatenate(sizes), np.concatenate(scores)
        self.start = np.cumsum(self.size) - self.size

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, float]]:
        if len(self.known) > KEPT_WORDS:
            self.clear()
        split = self.pieces.words.findall if self.pieces.free else lambda t: [t]
        cut = [split(SPACE_MARK + t.replace(" ", SPACE_MARK)) if t else [] for t in texts]
        new = set().union(*cut).difference(self.known)
        if new:
            self.learn(sorted(new))
        out = []
        for ws in cut:
            at = np.fromiter(map(self.known.__getitem__, ws), dtype=np.int64, count=len(ws))
            n = self.size[at]
            where = np.repeat(self.start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out.append((self.flat[where], float(self.score[at].sum())))
        return out


def _schema(docs: DataFrame, *more: T.StructField) -> T.StructType:
    return T.StructType([*(f for f in docs.schema.fields if f.name not in {m.name for m in more}), *more])


IDS = (T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("id_score", T.DoubleType()))


def _encoded(frames, model: str, text: str):
    encoder = Encoder(load(model))
    for pdf in frames:
        for k in range(0, len(pdf), 256):
            part = pdf.iloc[k : k + 256]
            ids, scores = zip(*encoder.encode([t if isinstance(t, str) else "" for t in part[text]]))
            yield part.assign(ids=list(ids), id_score=list(scores))


def _decoded(frames, model: str, ids: str, column: str):
    pieces = load(model)
    for pdf in frames:
        yield pdf.assign(**{column: pd.Series([None if i is None else decode_ids(i.tolist(), pieces) for i in pdf[ids]], dtype=object, index=pdf.index)})


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs with ids and the score of the segmentation (ids, id_score)."""
    schema = _schema(docs, *IDS)
    return docs.mapInPandas(lambda frames: (f[schema.names] for f in _encoded(frames, model, text)), schema)


def decode_ids(ids, pieces: Pieces) -> str:
    whole = b"".join(map(pieces.shown.__getitem__, ids))
    return whole[1:].decode("utf-8", "replace") if whole[:1] == b" " else whole.decode("utf-8", "replace")


def decode(encoded: DataFrame, model: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """encoded with the texts that its ids stand for; null ids give null."""
    schema = _schema(encoded, T.StructField(column, T.StringType()))
    return encoded.mapInPandas(lambda frames: (f[schema.names] for f in _decoded(frames, model, ids, column)), schema)


def round_trip(docs: DataFrame, model: str, text: str = "text", column: str = "decoded") -> DataFrame:
    """docs encoded and decoded again in one pass: ids, id_score and the decoded text."""
    schema = _schema(docs, *IDS, T.StructField(column, T.StringType()))
    return docs.mapInPandas(lambda frames: (f[schema.names] for f in _decoded(_encoded(frames, model, text), model, "ids", column)), schema)
