import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from voxspark.llm.lexical import POSTINGS, Chunk, LexicalParams, _lengths_norm, _post, search

DOCS = "doc_id long, text string, item long, score string, term int, df int"
ITEMS = "item_id long, text string, item int, rank int, block string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=50, b=50):
    bags = [(r[0], Counter(terms(r[1]))) for r in docs]
    bags = [(i, bag) for i, bag in bags if bag]
    n, total = len(bags), sum(sum(bag.values()) for _, bag in bags)
    df = Counter(t for _, bag in bags for t in bag)
    out = []
    for item in items:
        scored = []
        for i, bag in bags:
            m, score = 100 - b + (b * sum(bag.values()) * n) // total, 0
            for t in set(terms(item[1])):
                if t in bag:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(str(item[0]), rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcDEé中9", k=rng.randint(1, 6))) for _ in range(300)]
    odds = [1 / (i + 1) for i in range(300)]
    text = lambda k: "".join(w + rng.choice([" ", ", ", "\n", "-", "\x00", "\x7f"]) for w in rng.choices(words, odds, k=k))
    texts = [text(rng.randint(0, 60)) for _ in range(n)] + [None, "", " .,;", text(30_000), words[0] * 2000] + [text(10)] * 40
    rng.shuffle(texts)
    docs = [(i if i % 97 else None, t, 1, "s", 2, 3) for i, t in enumerate(texts)] + [(7, texts[8], 0, "", 0, 0), (7, texts[7], 0, "", 0, 0)]
    items = [(i, text(rng.randint(1, 40)), 1, 1, "b") for i in range(25)] + [(3, text(5), 0, 0, ""), (None, words[1], 0, 0, ""), (90, None, 0, 0, ""), (91, "", 0, 0, ""), (92, "nowhere-found", 0, 0, ""), (93, text(3000), 0, 0, "")]
    return docs, items


@pytest.mark.parametrize("seed,params", [(1, LexicalParams()), (2, LexicalParams(k=7, chunk_bytes=3000)), (3, LexicalParams(k=3, block_terms=100, chunk_bytes=20_000)), (4, LexicalParams(k=5000))])
def test_against_brute_force(spark, seed, params):
    docs, items = corpus(seed)
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    got = search(df, spark.createDataFrame(items, ITEMS), params=params).collect()
    assert sorted(((str(r.item_id), r.rank, r.doc_id, r.score) for r in got), key=str) == brute(docs, items, params.k)


def test_no_rows(spark):
    docs, items = spark.createDataFrame([(1, "a b", 0, "", 0, 0)], DOCS), spark.createDataFrame([(1, "a", 0, 0, "")], ITEMS)
    assert search(docs.limit(0), items).collect() == []
    assert search(docs, items.limit(0)).collect() == []
    assert search(spark.createDataFrame([(1, None, 0, "", 0, 0)], DOCS), items).collect() == []


def test_accumulators_stop(spark):
    """Once the rest can't reach the k-th best, documents with common terms alone get no accumulator."""
    docs = spark.createDataFrame([(i, "rare word word" if i < 5 else "word") for i in range(500)], "doc_id long, text string").coalesce(1)
    chunk = Chunk(docs.mapInPandas(_post({b"rare": 0, b"word": 1}, LexicalParams()), POSTINGS).first())
    chunk.weigh(500, 510, 50)
    docs, score = chunk.search(np.array([0, 1]), np.array([9000, 1]), 3, 0)
    assert docs.tolist() == [0, 1, 2, 3, 4] and (score > 9000).all()
    assert not chunk.scores.any()
    docs, _ = chunk.search(np.array([0, 1]), np.array([9000, 1]), 3, 1 << 60)
    assert len(docs) == 0


def test_lengths_beyond_64_bits():
    n = np.array([10**6, 3])
    assert _lengths_norm(n, 10**12, 10**14, 50).tolist() == [50 + 50 * 10**18 // 10**14, 50 + 150 * 10**12 // 10**14]
