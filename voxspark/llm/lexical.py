"""Ranked lexical search, term at a time with a limit on accumulators.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in
lower case.  Items are taken in blocks of bounded vocabulary.  For a block, tasks turn
their documents into chunks of postings of the block's terms; how many documents hold a
term is added up over the chunks.  A chunk is then searched for all items of the block:
an item's terms come in order of rarity, and each adds its weighted frequency to the
accumulators of the documents that hold it.  Before each term the most that this and all later terms can
add is compared with the k-th best partial score (of this chunk, or the k-th best final
score that the task has seen): once it is less, no further accumulators are made and the
other terms only update those that there are.  A task keeps an item's k best over all its
chunks; the tasks' k best are merged in the end.

Scores are whole numbers.  With N documents that hold a term at all, L terms in all, n terms in the
document, df documents that hold a term and tf its occurrences in one:

    w = floor(1000 ln((2 N + 2) / (2 df + 1)))
    m = 100 - b + (b n N) div L
    score = sum of w ((1000000000 tf) div (1000 tf + 20 m)) over the item's distinct terms

Results for odd inputs: a null or empty text holds no terms, such a document is in no
result and such an item has none; items that share an id are items of their own, each with
ranks from 1; documents that share an id are documents of their own; documents with
null ids are ranked and lose ties; a text of any length is counted whole; empty tables give no rows;
other columns are dropped, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .bytehash import as_bytes
from .chunks import expand, gather, squeeze
from ..scratch import Scratch

POSTINGS = "docs long, with_terms long, all_terms long, ids binary, none binary, lengths binary, terms binary, held binary, at binary, tf binary"
FOUND = "item long, item_id long, doc_id long, score long"
NO_ID = np.iinfo(np.int64).max

#: Bytes that are no part of a term become spaces, A-Z become a-z.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


@dataclass(frozen=True)
class LexicalParams:
    k: int = 50
    b: int = 50
    block_terms: int = 200_000  # (item, term) pairs of a block
    chunk_bytes: int = 8 << 20


def terms_of(text) -> list[bytes]:
    return as_bytes(text).translate(FOLD).split()


def _impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _lengths_norm(n: np.ndarray, documents: int, all_terms: int, b: int) -> np.ndarray:
    if b * documents * int(n.max(initial=0)) >= 1 << 63:
        return np.array([100 - b + b * int(x) * documents // all_terms for x in n], dtype=np.int64)
    return 100 - b + (b * n * documents) // all_terms


class Chunk:
    """The postings of one chunk, sorted by term, then document."""

    def __init__(self, row):
        self.ids, self.none = expand(row["ids"], "i8"), expand(row["none"], "u1").astype(bool)
        self.lengths, self.terms = expand(row["lengths"], "i8"), expand(row["terms"], "i8")
        held = expand(row["held"], "i8")
        self.ends = np.cumsum(held)
        self.starts = self.ends - held
        self.at, self.tf = expand(row["at"], "u4").astype(np.int64), expand(row["tf"], "i8")

    def weigh(self, documents: int, all_terms: int, b: int) -> None:
        self.impact = _impacts(self.tf, _lengths_norm(self.lengths, documents, all_terms, b)[self.at])
        self.most = np.maximum.reduceat(self.impact, self.starts) if len(self.starts) else self.impact
        self.scores = np.zeros(len(self.ids), dtype=np.int64)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among an item's k best, and their scores.

        terms: rarest first; floor: a score that k documents seen before have reached (0: none).
        """
        place = np.searchsorted(self.terms, terms)
        here = np.flatnonzero(place < len(self.terms))
        here = here[(self.terms[place[here]] == terms[here]) & (weights[here] > 0)]
        place, weights = place[here], weights[here]
        left = np.cumsum((weights * self.most[place])[::-1])[::-1]
        scores, survivors, best = self.scores, None, 0
        for i, (t, w) in enumerate(zip(place, weights)):
            docs, gain = self.at[self.starts[t] : self.ends[t]], self.impact[self.starts[t] : self.ends[t]]
            if survivors is None and left[i] < floor:
                survivors = np.flatnonzero(scores)
                kept = scores[survivors]
                scores[survivors] = 0
            if survivors is None:
                scores[docs] += w * gain
                best = max(best, int(scores[docs].max()))
                if i + 1 < len(left) and left[i + 1] < best:
                    partial = scores[scores > 0]
                    if len(partial) >= k:
                        floor = max(floor, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
            elif len(survivors):
                j = np.minimum(np.searchsorted(docs, survivors), len(docs) - 1)
                also = docs[j] == survivors
                kept[also] += w * gain[j[also]]
        if survivors is None:
            survivors = np.flatnonzero(scores)
            kept = scores[survivors]
            scores[survivors] = 0
        return survivors, kept


class Best:
    """An item's k best documents so far: highest score, then smallest id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.none = (np.empty(0, dtype=t) for t in (np.int64, np.int64, bool))

    @property
    def floor(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        score, ids, none = np.concatenate([self.score, score]), np.concatenate([self.id, ids]), np.concatenate([self.none, none])
        if len(score) > self.k:
            near = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids, none = score[near], ids[near], none[near]
        top = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.id, self.none = score[top], ids[top], none[top]


def _post(vocabulary: dict[bytes, int], p: LexicalParams):
    def chunk_row(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths, of, terms = [], [], []
        for i, text in enumerate(pdf["text"]):
            words = text.translate(FOLD).split()
            lengths.append(len(words))
            found = np.array([t for w in words if (t := vocabulary.get(w)) is not None], dtype=np.int64)
            terms.append(found)
            of.append(np.full(len(found), i, dtype=np.int64))
        n = np.array(lengths, dtype=np.int64)
        keys, tf = np.unique(np.concatenate(terms) * len(pdf) + np.concatenate(of), return_counts=True)
        term, held = np.unique(keys // len(pdf), return_counts=True)
        none = pdf["doc_id"].isna().to_numpy()
        return pd.DataFrame([{
            "docs": len(pdf), "with_terms": int((n > 0).sum()), "all_terms": int(n.sum()), "ids": squeeze(pdf["doc_id"].fillna(NO_ID).to_numpy(dtype=np.int64)), "none": squeeze(none.astype(np.uint8)),
            "lengths": squeeze(n), "terms": squeeze(term), "held": squeeze(held.astype(np.int64)), "at": squeeze((keys % len(pdf)).astype(np.uint32)), "tf": squeeze(tf.astype(np.int64)),
        }])

    def post(frames):
        for _, pdf in gather((f.astype({"doc_id": "Int64"}) for f in frames), p.chunk_bytes, row_bytes=64):
            yield chunk_row(pdf)

    return post


def _holders(frames):
    for pdf in frames:
        for terms, held in zip(pdf["terms"], pdf["held"]):
            yield pd.DataFrame({"term": expand(terms, "i8"), "df": expand(held, "i8")})


def _search(items: list[tuple], documents: int, all_terms: int, p: LexicalParams):
    def search(frames):
        best = [Best(p.k) for _ in items]
        for pdf in frames:
            for _, row in pdf.iterrows():
                chunk = Chunk(row)
                chunk.weigh(documents, all_terms, p.b)
                for (_, _, terms, weights), top in zip(items, best):
                    docs, score = chunk.search(terms, weights, p.k, top.floor)
                    top.add(score, chunk.ids[docs], chunk.none[docs])
        for (item, item_id, *_), top in zip(items, best):
            if len(top.score):
                ids = pd.array(np.where(top.none, 0, top.id), dtype="Int64")
                ids[top.none] = pd.NA
                yield pd.DataFrame({"item": item, "item_id": pd.array([item_id] * len(ids), dtype="Int64"), "doc_id": ids, "score": top.score})

    return search


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, term): the distinct terms of each row of items, which gets a number of its own."""

    def split(frames):
        for pdf in frames:
            rows = [(i, d, t) for i, d, x in zip(pdf["item"], pdf["item_id"].astype("Int64"), pdf["text"]) for t in sorted(set(terms_of(x)))]
            yield pd.DataFrame(rows, columns=["item", "item_id", "term"]).astype({"item": "int64", "item_id": "Int64"})

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInPandas(split, "item long, item_id long, term binary")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", params: LexicalParams = LexicalParams(), scratch: Scratch | None = None) -> DataFrame:
    """(item, item_id, rank, doc_id, score): the k best documents of each row of items."""
    spark, p = docs.sparkSession, params
    scratch = scratch or Scratch(spark, "lexical")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = scratch.keep(item_terms(items, item_id, item_text), "items")
    blocks = max(1, math.ceil(asked.count() / p.block_terms))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    found = spark.createDataFrame([], FOUND)
    for block in range(blocks):
        pairs = asked.where(F.col("block") == block).orderBy("item", "term").collect()  # bounded by block_terms
        vocabulary = {t: k for k, t in enumerate(sorted({bytes(r.term) for r in pairs}))}
        if not vocabulary:
            continue
        postings = scratch.keep(docs.mapInPandas(_post(vocabulary, p), POSTINGS), "postings")
        totals = postings.agg(F.sum("with_terms").alias("documents"), F.sum("all_terms").alias("terms")).first()
        if not totals.documents:
            break
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for r in postings.select("terms", "held").mapInPandas(_holders, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row a term of the block
            df[r.term] = r.df
        weight = np.array([math.floor(1000 * math.log((2 * totals.documents + 2) / (2 * int(n) + 1))) for n in df], dtype=np.int64)
        of: dict[int, tuple] = {}
        for r in pairs:
            of.setdefault(r.item, (r.item, r.item_id, []))[2].append(vocabulary[bytes(r.term)])
        asking = []
        for item, known_as, terms in of.values():
            ranked = np.array(sorted((t for t in terms if df[t]), key=lambda t: (df[t], t)), dtype=np.int64)  # rarest first
            asking.append((item, known_as, ranked, weight[ranked]))
        found = found.unionByName(scratch.keep(postings.mapInPandas(_search(asking, totals.documents, totals.terms, p), FOUND), "found"))
        scratch.drop(postings)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = found.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k)
    return scratch.finish(top.select("item", "item_id", "rank", "doc_id", "score"))
