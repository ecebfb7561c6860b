"""Quality classifier: supervised subword embeddings.

A document is the average of learnt vectors of its features: words, pairs of
neighbouring words, and byte n-grams inside words with their rims, each hashed to one of
``buckets`` vectors.  A word said twice in a row is one pair, whatever the word.  A
softmax over the average gives the classes; both are fitted by stochastic gradient
descent, the classes taking turns.

The fit takes at most ``per_class`` labelled documents of each class; scoring reads
every text whole.  For a linear output the average of vectors is an average of one
number per bucket, so scoring needs only a table of ``buckets`` floats in each task.

Results for odd inputs: null and empty texts have no features and get the share of
class 1; without labels of both classes every score is that share (one half without
any); rows with null or repeated ids are scored each; a text of any length is read whole; an empty
table gives no rows; other columns pass through, but columns named `score` and `predicted` give way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .bytehash import SPACE, U, Rolling, batches, combine, pieces, word_spans
from .labelled import binary_labels, sample_texts, scored

SAME = U(0x5A3E)


@dataclass(frozen=True)
class SubwordParams:
    buckets: int = 1 << 17
    dims: int = 8
    ngrams: tuple[int, ...] = (3, 4, 5)
    epochs: int = 6
    least_steps: int = 12_000
    rate: float = 0.2
    per_class: int = 1500
    max_bytes: int = 1 << 16
    threshold: float = 0.3
    seed: int = 1


def _features(texts: list[bytes], p: SubwordParams):
    """(bucket, valid, start of each text) of the features of each kind."""
    data = np.frombuffer(b"".join(b" " + t + b" " for t in texts), dtype=np.uint8)
    starts = np.cumsum([0, *(len(t) + 2 for t in texts)])
    rolling = Rolling(data)
    spaces = np.concatenate([[0], np.cumsum(SPACE[data])])
    for n in p.ngrams:
        keys = rolling.windows(n)
        k = np.arange(len(keys))
        inside = spaces[k + n - 1] == spaces[k + 1]
        yield (keys % U(p.buckets)).astype(np.int64), inside, np.minimum(starts, len(keys))
    a, b = word_spans(data)
    words = rolling.slices(a, b)
    upto = np.searchsorted(a, starts)
    yield (combine(words) % U(p.buckets)).astype(np.int64), np.ones(len(words), bool), upto
    if len(words) > 1:
        pair = combine(words[:-1], words[1:])
        pair[words[:-1] == words[1:]] = SAME
        of = np.repeat(np.arange(len(texts)), np.diff(upto))
        yield (pair % U(p.buckets)).astype(np.int64), of[:-1] == of[1:], np.minimum(upto, len(pair))


def _rows(texts: list[bytes], p: SubwordParams):
    """Distinct buckets and their shares, for each text."""
    for t in texts:
        parts = [bucket[ok] for bucket, ok, _ in _features([t], p)]
        at, n = np.unique(np.concatenate(parts), return_counts=True)
        yield at, n / max(1, n.sum())


def train(texts: list[bytes], classes: list[int], counts: list[int], p: SubwordParams = SubwordParams()) -> tuple[np.ndarray, float]:
    """One number per bucket and a bias: the log odds of class 1 are the average number plus the bias."""
    prior = float(np.log((counts[1] + 1) / (counts[0] + 1)))
    if len(set(classes)) < 2:
        return np.zeros(p.buckets, dtype=np.float32), prior
    rng = np.random.default_rng(p.seed)
    vectors = rng.uniform(-1, 1, (p.buckets, p.dims)) / p.dims
    out, bias = rng.uniform(-1, 1, (p.dims, 2)), np.zeros(2)
    rows, y = list(_rows(texts, p)), np.array(classes)
    steps = max(p.least_steps, p.epochs * len(rows))
    turns = [np.concatenate([rng.permutation(np.flatnonzero(y == c)) for _ in range(steps // 2 // (y == c).sum() + 1)]) for c in (0, 1)]
    for step in range(steps):
        k = turns[step % 2][step // 2]  # the classes take turns
        at, share = rows[k]
        rate = p.rate * (1 - step / steps)
        if not len(at):
            continue
        hidden = share @ vectors[at]
        z = hidden @ out + bias
        q = np.exp(z - z.max())
        g = q / q.sum() - np.eye(2)[y[k]]
        back = out @ g
        out -= rate * np.outer(hidden, g)
        bias -= rate * g
        vectors[at] -= np.outer(share * (rate / (share @ share)), back)  # moves the average by rate * back
    table = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32)
    return table, float(bias[1] - bias[0])


def log_odds(texts: list[bytes], table: np.ndarray, bias: float, prior: float, p: SubwordParams) -> np.ndarray:
    parts, of = pieces(texts, 1 << 20)
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for i, j in batches(parts, 1 << 20):
        for bucket, ok, starts in _features(parts[i:j], p):
            value = np.concatenate([[0.0], np.cumsum(np.where(ok, table[bucket], 0.0), dtype=np.float64)])
            number = np.concatenate([[0], np.cumsum(ok)])
            np.add.at(total, of[i:j], np.diff(value[starts]))
            np.add.at(count, of[i:j], np.diff(number[starts]))
    return np.where(count > 0, total / np.maximum(count, 1) + bias, prior)


def classify(docs: DataFrame, labels: DataFrame, learn: Column, column: str = "quality", params: SubwordParams = SubwordParams()) -> DataFrame:
    """docs with score (of class 1) and predicted; labels(doc_id, column) are learnt from where `learn` holds."""
    texts, classes, counts = sample_texts(docs, binary_labels(labels, column, learn), (params.per_class, params.per_class), params.max_bytes)
    table, bias = train(texts, classes, counts, params)
    prior = float(np.log((counts[1] + 1) / (counts[0] + 1)))
    model = docs.sparkSession.sparkContext.broadcast(table)  # 4 * buckets bytes

    def score(batch: list[bytes]):
        return 1 / (1 + np.exp(-np.clip(log_odds(batch, model.value, bias, prior, params), -500, 500)))

    return scored(docs, score).withColumn("predicted", (F.col("score") >= params.threshold).cast("int"))
