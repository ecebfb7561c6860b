"""Language-model scoring with a probabilistic suffix tree.

The tree's nodes are contexts of up to ``depth`` preceding words; the start of a text
counts as a word.  A context seen ``min_context`` times is kept when the training text
supports it: its leave-one-out log-likelihood must exceed that of its suffix by
``min_gain`` nats a symbol.  Next-word distributions are smoothed by giving each kept
context its number of different successors as mass for its suffix (Witten-Bell), down
to the add-one distribution of single words, so that after every context the
probabilities of all words and of one unseen word add up to one.  A text is scored
from the longest kept context at each position.

How it is counted: words get numbers in the order of their frequency, so that a number
tells its count.  Each chunk of documents sends every position, as its preceding words
and its word, to the task that holds all positions after the same last word; that task
grows the subtree of this word, tests its contexts level by level and answers with
probabilities.  A context of more than ``hot`` positions is dealt out by one word more,
and again until no task gets more of one context; the counts after hot contexts are
summed by an exchange of their own, in which each chunk sends a successor once.  There
are at most tokens / hot of them at a level.

All counts are taken over the whole training part.  At ``min_context=2`` no context is
left out, as one seen once never passes the leave-one-out test.

Results for odd inputs: a null text is empty and consists of the end token; rows with a
null id are scored and not learnt from; equal rows are scored each; a text of any
length is scored whole; an empty table gives no rows; columns other than doc_id and
text are dropped, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .bytehash import U, Rolling, batches, join_texts, lower_ascii, mix, word_spans
from .chunks import SENT, corpus_bytes, expand, first_of_key, gather, n_chunks, pack_keys, pack_sent, reduce_keys, squeeze, unpack_keys, unpack_reply, with_replies
from ..scratch import Scratch

END = U(1)
NONE, START, FIRST_WORD = 0, 1, 2  # numbers of words: nothing before the start, the start, the most frequent word
DOCS = "chunk long, ids binary, known binary, train binary, n_tokens binary, stream binary"
SENT_ROWS = "chunk long, bucket int, n int, rows binary"
SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_deep long"
SHARES = "ctx long, word long, gain double, many long, singles long, types long"


@dataclass(frozen=True)
class TreeParams:
    depth: int = 4
    min_context: int = 2
    min_gain: float = 0.0
    chunk_bytes: int = 4 << 20
    hot: int = 1 << 19  # positions of one context in one task


def _encode(chunk: int, pdf: pd.DataFrame) -> dict:
    """A chunk's documents as indices into its sorted vocabulary of word keys."""
    streams, counts = [], np.empty(len(pdf), dtype=np.int32)
    texts = list(pdf["text"])
    for i, j in batches(texts, 1 << 20):
        data, starts = join_texts(texts[i:j], 1)
        data = lower_ascii(data)
        a, b = word_spans(data)
        keys = Rolling(data).slices(a, b)
        upto = np.searchsorted(a, starts)
        counts[i:j] = np.diff(upto) + 1
        streams.append(np.insert(keys, upto[1:], END))
    vocab, stream = np.unique(np.concatenate(streams), return_inverse=True)
    ids = pdf["doc_id"]
    return {
        "chunk": chunk, "ids": ids.fillna(0).to_numpy(dtype=np.int64).tobytes(), "known": ids.notna().to_numpy().tobytes(),
        "train": pdf["train"].to_numpy(dtype=bool).tobytes(), "n_tokens": counts.tobytes(), "stream": squeeze(stream.astype(np.uint32)), "vocab": pack_keys(vocab),
    }


def _number_words(inverse, values, n, keys):
    """Of each word its count and its place among the bucket's words of that count; the note: counts and numbers of words."""
    total = np.bincount(inverse, values, n).astype(np.uint64)
    order = np.argsort(total, kind="stable")
    counts, at, many = np.unique(total[order], return_index=True, return_counts=True)
    place = np.empty(n, dtype=np.uint64)
    place[order] = np.arange(n) - np.repeat(at, many)
    return np.stack([total[inverse], place[inverse]], axis=1), np.stack([counts, many.astype(np.uint64)]).tobytes()


def _count(inverse, values, n, keys):
    """Of each key its count, and whether the asking chunk is the one that answers for it."""
    total = np.bincount(inverse, values, n).astype(np.uint64)
    return (total[inverse] << U(1)) | first_of_key(inverse, n), None


def _gain(c: np.ndarray, p_suffix: np.ndarray) -> np.ndarray:
    """What a successor of two or more occurrences adds to its context's gain, but for the context's own count."""
    return np.where(c >= 2, c * (np.log(np.maximum(c - 1, 1)) - np.log(p_suffix)), 0.0)


def _kept(gain, many, singles, types, p: TreeParams) -> np.ndarray:
    """The number of successors of each context that its divergence from its suffix keeps, 0 for the others.

    many: occurrences of successors with two or more of them; singles: successors with one.
    """
    size = many + singles
    safe, t = np.maximum(size, 1), np.maximum(types, 1)
    loo = gain - many * np.log(safe + t) + singles * np.log(t / (safe + t))
    return np.where((size >= max(1, p.min_context)) & (loo > p.min_gain * size), types, 0)


class _Words:
    """What a word's number tells: numbers are given by falling count."""

    def __init__(self, counts: np.ndarray, many: np.ndarray):
        order = np.argsort(-counts)
        self.counts, many = counts[order], many[order]
        self.first = np.cumsum(many) - many
        self.size = int(many.sum())
        self.types, self.tokens = int(many[self.counts > 0].sum()), int((self.counts * many).sum())
        if self.size >= (1 << 32) - FIRST_WORD:
            raise ValueError("more than 2**32 different words")

    def count(self, word: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.first, word.astype(np.int64) - FIRST_WORD, "right") - 1] if self.size else np.zeros(len(word), dtype=np.int64)

    def p0(self, count: np.ndarray) -> np.ndarray:
        return (count + 1) / (self.tokens + self.types + 1)


class _Hot:
    """The hot contexts of one level: codes of their parent's index and their last word; once decided, sizes and kept successors."""

    def __init__(self, tuples: list[tuple[int, ...]], above: "_Hot | None"):
        index = {t: i for i, t in enumerate(above.tuples)} if above else {(): 0}
        found = sorted((index[t[:-1]] << 32 | t[-1], t) for t in tuples if t[:-1] in index)
        self.codes, self.tuples = np.array([c for c, _ in found], dtype=np.int64), [t for _, t in found]
        self.size = self.types = np.zeros(len(found))

    def find(self, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The index of each context, or -1."""
        if not len(self.codes):
            return np.full(len(word), -1, dtype=np.int64)
        code = np.where(parent >= 0, parent, -1) << 32 | word
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((parent >= 0) & (self.codes[at] == code), at, -1)


class _Chunk:
    """The positions of a chunk: their word, the words before it, and what is known of their probability."""

    def __init__(self, row, p: TreeParams, words: _Words):
        self.id, self.p, self.words = int(row["chunk"]), p, words
        self.n_tokens = np.frombuffer(row["n_tokens"], dtype=np.int32)
        self.word = expand(row["stream"], np.uint32).astype(np.int64)
        self.train = np.repeat(np.frombuffer(row["train"], dtype=bool), self.n_tokens)
        self.doc_start = np.cumsum(self.n_tokens) - self.n_tokens
        self.at = np.arange(len(self.word)) - np.repeat(self.doc_start, self.n_tokens)
        self.count = words.count(self.word)
        self.base = words.p0(self.count)
        self.prob = self.base.copy()
        self.deep = np.zeros(len(self.word), dtype=bool)
        self.level = np.zeros(len(self.word), dtype=np.int8)  # words of the deepest hot context
        self.of = np.zeros(len(self.word), dtype=np.int64)  # its index, -1 once a context was not hot

    def before(self, k: int) -> np.ndarray:
        """The word k places before each position."""
        out = np.full(len(self.word), NONE, dtype=np.int64)
        out[k:] = self.word[:-k]
        out[self.at < k] = NONE
        out[self.at == k - 1] = START
        return out

    def grams(self, k: int, hot: _Hot):
        """Go down one level of hot contexts; its grams and where each position's stands."""
        self.of = hot.find(self.of, self.before(k))
        self.sel = np.flatnonzero(self.of >= 0)
        self.level[self.sel] = k
        codes, self.gram = np.unique(self.of[self.sel] << 32 | self.word[self.sel], return_inverse=True)
        key = mix(codes.astype(U))  # one to one
        self.order = np.argsort(key)
        return codes, key[self.order]

    def counts(self, codes: np.ndarray, reply: np.ndarray):
        got = np.empty(len(codes), dtype=U)
        got[self.order] = reply
        return (got >> U(1)).astype(np.int64), (got & U(1)).astype(bool)

    def shares(self, codes: np.ndarray, c: np.ndarray, own: np.ndarray, limit: int) -> pd.DataFrame:
        """What this chunk answers for: sums of the hot contexts, and grams that are hot themselves."""
        p = np.empty(len(codes))
        p[self.gram] = self.prob[self.sel]
        use = own & (c > 0)
        ctx, word, c, p = codes[use] >> 32, codes[use] & 0xFFFFFFFF, c[use], p[use]
        sums = pd.DataFrame({"ctx": ctx, "word": -1, "gain": _gain(c, p), "many": np.where(c >= 2, c, 0), "singles": c == 1, "types": 1}).groupby("ctx", as_index=False).sum()
        sums["word"] = -1
        big = c >= limit
        hot = pd.DataFrame({"ctx": ctx[big], "word": word[big], "gain": 0.0, "many": 0, "singles": 0, "types": 0})
        return pd.concat([sums.astype({"singles": "int64"}), hot], ignore_index=True)

    def descend(self, k: int, hot: _Hot, reply: np.ndarray) -> None:
        codes, _ = self.grams(k, hot)
        c, _ = self.counts(codes, reply)
        c, size, t = c[self.gram], hot.size[self.of[self.sel]], hot.types[self.of[self.sel]]
        self.prob[self.sel] = np.where(t > 0, (c + t * self.prob[self.sel]) / np.maximum(size + t, 1), self.prob[self.sel])
        self.deep[self.sel] |= (t > 0) & (k > 1)

    def asked(self, buckets: int):
        """The positions whose deeper contexts a bucket decides, as distinct rows, in order of bucket; where each position's row stands."""
        d = self.p.depth
        columns = [self.before(k) for k in range(1, d + 1)]
        known = np.concatenate([[0], self.count[:-1]])
        open_ = (self.at == 0) | (known >= self.p.min_context)  # a rarer word is no context that is tested
        open_ &= self.level < d
        key, same = np.zeros(len(self.word), dtype=U), mix(self.word.astype(U))
        for k, column in enumerate(columns):
            key = np.where(self.level >= k, mix(key * U(3) + column.astype(U)), key)
            same = mix(same * U(5) + column.astype(U))
            open_ &= (self.level != k) | (column != NONE)
        at = np.flatnonzero(open_)
        columns = [c[at] for c in columns] + [self.word[at]]
        bucket = ((key[at] >> U(32)).astype(np.int64) * buckets) >> 32
        # one sort by bucket, last word and the leading bits of the word before it; a hash brings equal rows together, but for chance
        wide, most = int(max(c.max(initial=0) for c in columns[:2])).bit_length(), (buckets - 1).bit_length()
        spare = 64 - wide - most
        lead = min(wide, spare - 12)
        code = (bucket << wide | columns[0]).astype(U) << U(spare) | (columns[1] >> (wide - lead)).astype(U) << U(spare - lead)
        by = np.argsort(code | same[at] >> U(64 - spare + lead))
        columns = [c[by].astype(np.uint32) for c in columns]
        new = np.ones(len(by), dtype=bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        rows = by[new]
        of = np.empty(len(at), dtype=np.int64)
        of[by] = np.cumsum(new) - 1
        n = np.bincount(of, self.train[at], len(rows)).astype(np.uint32)
        return at, of, bucket[rows], [c[new] for c in columns], n, self.level[at[rows]], self.prob[at[rows]]

    def messages(self, buckets: int) -> pd.DataFrame:
        _, _, bucket, columns, n, level, prob = self.asked(buckets)
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = []
        for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            if j > i:
                part = [np.diff(columns[0][i:j], prepend=np.uint32(0)), *(c[i:j] for c in columns[1:]), n[i:j]]
                data = [squeeze(np.concatenate(part)), squeeze(level[i:j]), squeeze(prob[i:j][level[i:j] > 0].astype(np.float32))]
                rows.append((self.id, b, j - i, b"".join([*(len(x).to_bytes(4, "little") for x in data), *data])))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "n", "rows"])


def _unpack(data: bytes, n: int, depth: int):
    ends = 12 + np.cumsum([0, *(int.from_bytes(data[4 * k : 4 * k + 4], "little") for k in range(3))])
    main, level, prob = (data[i:j] for i, j in zip(ends[:-1], ends[1:]))
    columns = expand(main, np.uint32).reshape(depth + 2, n)
    return np.concatenate([np.cumsum(columns[:1], axis=1, dtype=np.uint32), columns[1:]]), expand(level, np.int8), expand(prob, np.float32)


def _grow(pdf: pd.DataFrame, p: TreeParams, words: _Words) -> pd.DataFrame:
    """The subtrees of a bucket: log10 probabilities of its rows, those from contexts of two or more words with their sign turned."""
    pdf = pdf.sort_values("chunk", kind="stable")
    parts = [_unpack(data, n, p.depth) for data, n in zip(pdf["rows"], pdf["n"])]
    columns = np.concatenate([x[0] for x in parts], axis=1)
    level = np.concatenate([x[1] for x in parts])
    before, word, n = columns[: p.depth], columns[-2].astype(np.int64), columns[-1].astype(np.int64)
    prob = words.p0(words.count(word))
    prob[level > 0] = np.concatenate([x[2] for x in parts])
    deep = np.zeros(len(word), dtype=bool)
    del parts
    at, ctx = np.arange(len(word)), np.zeros(len(word), dtype=np.int64)
    for k in range(1, p.depth + 1):
        here = before[k - 1][at] != NONE
        at, ctx = at[here], ctx[here]
        _, ctx = np.unique(ctx << 32 | before[k - 1][at], return_inverse=True)
        use = np.flatnonzero(level[at] < k)  # the counts of hot contexts are not whole here
        rows, of = at[use], ctx[use]
        codes, gram = np.unique(of << 32 | word[rows], return_inverse=True)
        c = np.bincount(gram, n[rows], len(codes)).astype(np.int64)
        suffix = np.empty(len(codes))
        suffix[gram] = prob[rows]
        total = lambda x: np.bincount(codes >> 32, x, int(ctx.max(initial=-1)) + 1)  # noqa: E731, B023
        many, singles = total(np.where(c >= 2, c, 0)), total(c == 1)
        t = _kept(total(_gain(c, suffix)), many, singles, total(c > 0), p)
        t_row, size = t[of], (many + singles)[of]
        prob[rows] = np.where(t_row > 0, (c[gram] + t_row * prob[rows]) / np.maximum(size + t_row, 1), prob[rows])
        deep[rows] |= (t_row > 0) & (k > 1)
        go = np.ones(len(at), dtype=bool)
        go[use] = size >= p.min_context
        at, ctx = at[go], ctx[go]
    logs = np.log10(prob)
    logs = np.where(deep, -logs, logs).astype(np.float32)  # a probability is below one, so that the sign is free
    cut = np.cumsum([0, *pdf["n"]])
    return pd.DataFrame({"kind": "rows", "chunk": pdf["chunk"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "reply": [squeeze(logs[i:j]) for i, j in zip(cut[:-1], cut[1:])]})


def _rows(frames):
    for pdf in frames:
        for k in range(len(pdf)):
            yield pdf.iloc[k]


def _numbered(docs: DataFrame, params: TreeParams, buckets: int, scratch: Scratch) -> tuple[DataFrame, _Words]:
    """The chunks with their words as numbers; what the numbers tell."""

    def encode(it):
        for chunk, pdf in gather(it, params.chunk_bytes):
            yield pd.DataFrame([_encode(chunk, pdf)])

    def send(it):
        for row in _rows(it):
            vocab, stream = unpack_keys(row["vocab"]), expand(row["stream"], np.uint32)
            train = np.repeat(np.frombuffer(row["train"], dtype=bool), np.frombuffer(row["n_tokens"], dtype=np.int32))
            yield pack_sent("words", int(row["chunk"]), vocab, np.bincount(stream[train], minlength=len(vocab)).astype(np.uint32), buckets)

    def spread(it):
        for row in _rows(it):
            counts, many = np.frombuffer(row["note"], dtype=U).reshape(2, -1).astype(np.int64)
            yield pd.DataFrame({"bucket": int(row["bucket"]), "count": counts, "many": many})

    texts = scratch.keep_bucketed(docs.mapInPandas(encode, DOCS + ", vocab binary"), "chunk", buckets, "texts")
    asked = scratch.keep(reduce_keys(texts.mapInPandas(send, SENT), {"words": _number_words}, {"words": "<u4"}), "words")
    sizes = scratch.keep(asked.where("note IS NOT NULL").select("bucket", "note").mapInPandas(spread, "bucket int, count long, many long"), "sizes")
    found = sizes.groupBy("count").agg(F.sum("many").alias("many")).collect()  # at most the root of twice the number of tokens
    words = _Words(np.array([r["count"] for r in found], dtype=np.int64), np.array([r["many"] for r in found], dtype=np.int64))
    earlier = F.coalesce(F.sum("many").over(Window.partitionBy("count").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sizes.withColumn("skip", earlier).select("bucket", "count", "skip")

    def number(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        """The numbers of the words that each chunk asked a bucket about."""
        own, out = own.sort_values("count"), []
        for reply in asked["reply"]:
            count, place = expand(reply, np.dtype("V16")).view(U).reshape(-1, 2).astype(np.int64).T
            skip = own["skip"].to_numpy()[np.searchsorted(own["count"].to_numpy(), count)]
            out.append(squeeze((words.first[np.searchsorted(-words.counts, -count)] + skip + place + FIRST_WORD).astype(np.uint32)))
        return asked[["chunk", "bucket"]].assign(kind="words", reply=out)

    def write(it):
        for row in _rows(it):
            ids = unpack_reply(row["words"], "<u4")
            yield pd.DataFrame([{**{c: row[c] for c in ("chunk", "ids", "known", "train", "n_tokens")}, "stream": squeeze(ids[expand(row["stream"], np.uint32)])}])

    numbers = asked.select("chunk", "bucket", "reply").groupBy("bucket").cogroup(places.groupBy("bucket")).applyInPandas(number, "chunk long, bucket int, kind string, reply binary")
    store = scratch.keep_bucketed(with_replies(texts, buckets, words=numbers).mapInPandas(write, DOCS), "chunk", buckets, "tokens")
    scratch.drop(texts, asked)
    return store, words


def _hot_contexts(store: DataFrame, params: TreeParams, words: _Words, n_docs: int, buckets: int, scratch: Scratch) -> tuple[list[_Hot], dict[str, DataFrame]]:
    """The hot contexts of each level, decided, and the counts of the words after them."""
    hots, replies = [], {}
    n = int(words.first[np.searchsorted(-words.counts, -params.hot, "right")]) if (words.counts < params.hot).any() else words.size
    tuples = [(FIRST_WORD + i,) for i in range(n)] + ([(START,)] if n_docs >= params.hot else [])
    for k in range(1, params.depth + 1):
        hot = _Hot(tuples, hots[-1] if hots else None)
        if not len(hot.codes):
            break

        def known(row) -> _Chunk:
            c = _Chunk(row, params, words)
            for level, h in enumerate(hots, 1):
                c.descend(level, h, unpack_reply(row[f"hot{level}"], "<u8"))
            return c

        def send(it, k=k, hot=hot):
            for row in _rows(it):
                c = known(row)
                codes, keys = c.grams(k, hot)
                yield pack_sent(f"hot{k}", c.id, keys, np.bincount(c.gram, c.train[c.sel], len(codes)).astype(np.uint32)[c.order], buckets)

        def share(it, k=k, hot=hot):
            for row in _rows(it):
                c = known(row)
                codes, _ = c.grams(k, hot)
                yield c.shares(codes, *c.counts(codes, unpack_reply(row[f"hot{k}"], "<u8")), params.hot)

        sent = with_replies(store, buckets, **replies).mapInPandas(send, SENT)
        replies[f"hot{k}"] = scratch.keep(reduce_keys(sent, {f"hot{k}": _count}, {f"hot{k}": "<u4"}), f"hot{k}")
        shares = scratch.keep(with_replies(store, buckets, **replies).mapInPandas(share, SHARES), "shares")
        sums = shares.where("word < 0").groupBy("ctx").agg(*(F.sum(c).alias(c) for c in ("gain", "many", "singles", "types"))).collect()  # one row a hot context
        gain, many, singles, types = (np.zeros(len(hot.codes)) for _ in range(4))
        for r in sums:
            gain[r["ctx"]], many[r["ctx"]], singles[r["ctx"]], types[r["ctx"]] = r["gain"], r["many"], r["singles"], r["types"]
        hot.size, hot.types = many + singles, _kept(gain, many, singles, types, params)
        tuples = [(r["word"], *hot.tuples[r["ctx"]]) for r in shares.where("word >= 0").collect()]  # at most tokens / hot
        hots.append(hot)
    return hots, replies


def score(docs: DataFrame, train: Column, params: TreeParams = TreeParams(), scratch: Scratch | None = None) -> DataFrame:
    """log10 probability of each text of docs(doc_id, text) under a tree learnt where `train` holds.

    Also the number of tokens, of tokens seen in training, the base score of single
    words and the number of positions scored from a context of two or more words.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffix-tree")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    buckets = n_chunks(corpus_bytes(docs), params.chunk_bytes)
    store, words = _numbered(docs, params, buckets, scratch)
    n_docs = docs.where("train").count()
    hots, replies = _hot_contexts(store, params, words, n_docs, buckets, scratch)

    def known(row) -> _Chunk:
        c = _Chunk(row, params, words)
        for level, hot in enumerate(hots, 1):
            c.descend(level, hot, unpack_reply(row[f"hot{level}"], "<u8"))
        return c

    def send(it):
        for row in _rows(it):
            yield known(row).messages(buckets)

    sent = with_replies(store, buckets, **replies).mapInPandas(send, SENT_ROWS)
    grown = sent.groupBy("bucket").applyInPandas(lambda pdf: _grow(pdf, params, words), "kind string, chunk long, bucket int, reply binary")
    replies["rows"] = scratch.keep(grown, "rows")

    def finish(it):
        for row in _rows(it):
            c = known(row)
            at, of, *_ = c.asked(buckets)
            logs, base = np.log10(c.prob), np.log10(c.base)
            reply = unpack_reply(row["rows"], "<f4").astype(np.float64)
            logs[at] = -np.abs(reply)[of]
            c.deep[at] |= (reply > 0)[of]
            by_doc = lambda x: np.add.reduceat(x, c.doc_start)  # noqa: E731, B023
            ids = pd.array(np.frombuffer(row["ids"], dtype=np.int64), dtype="Int64")
            ids[~np.frombuffer(row["known"], dtype=bool)] = pd.NA
            yield pd.DataFrame({
                "doc_id": ids, "n_tokens": c.n_tokens.astype(np.int64), "n_known": by_doc((c.count > 0).astype(np.int64)), "train_tokens": words.tokens,
                "base_score": by_doc(base), "score": by_doc(logs), "n_deep": by_doc(c.deep.astype(np.int64)),
            })

    return scratch.finish(with_replies(store, buckets, **replies).mapInPandas(finish, SCORES), "scores")
