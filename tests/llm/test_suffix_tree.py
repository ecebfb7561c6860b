import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxspark.llm.queries import QUERIES, remainder
from voxspark.llm.suffix_tree import TreeParams, score

END, START = "<end>", "<start>"


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


class Brute:
    """The whole tree in dictionaries."""

    def __init__(self, rows, train, low, depth):
        self.depth, self.count = depth, Counter()
        docs = 0
        for (_, text), t in zip(rows, train):
            if t:
                w = [START, *tokens(text)]
                docs += 1
                self.count.update(tuple(w[i - k : i + 1]) for i in range(1, len(w)) for k in range(min(i, depth) + 1))
        self.n, self.v = sum(c for g, c in self.count.items() if len(g) == 1), sum(len(g) == 1 for g in self.count)
        self.size = lambda ctx: docs if ctx == (START,) else self.count[ctx]
        self.after = {}
        for g, c in self.count.items():
            if len(g) > 1:
                self.after.setdefault(g[:-1], {})[g[-1]] = c
        self.types = {}
        for ctx in sorted(self.after, key=len):
            x, total = self.after[ctx], sum(self.after[ctx].values())
            if total >= low:
                many = {t: c for t, c in x.items() if c >= 2}
                singles = len(x) - len(many)
                loo = sum(c * math.log((c - 1) / (total * self.prob(ctx[1:], t))) for t, c in many.items())
                loo += (total - singles) * math.log(total / (total + len(x))) + singles * math.log(len(x) / (total + len(x)))
                self.types[ctx] = len(x) if loo > 0 else 0

    def prob(self, ctx, t):
        if not ctx:
            return (self.count[t,] + 1) / (self.n + self.v + 1)
        k = self.types.get(ctx, 0)
        return (self.count[(*ctx, t)] + k * self.prob(ctx[1:], t)) / (self.size(ctx) + k) if k else self.prob(ctx[1:], t)

    def contexts(self, text):
        w = [START, *tokens(text)]
        return [(tuple(w[max(0, k - self.depth) : k]), w[k]) for k in range(1, len(w))]

    def score(self, rows):
        for i, text in rows:
            found = self.contexts(text)
            deep = sum(any(self.types.get(ctx[j:], 0) for j in range(len(ctx) - 1)) for ctx, _ in found)
            yield i, len(found), sum(self.count[t,] > 0 for _, t in found), self.n, sum(math.log10(self.prob((), t)) for _, t in found), sum(math.log10(self.prob(*c)) for c in found), deep


def docs(seed, n=120):
    rng = random.Random(seed)
    words = ["The", "the", "of", "and", "é", "x,", *("".join(rng.choices("abcdef", k=4)) for _ in range(60))]
    phrase = [" ".join(rng.choices(words, k=6)) for _ in range(8)]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choices([*words[:6] * 5, *words, *phrase * 3], k=rng.randint(0, 60)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " \u0085  x"), (n + 3, rows[5][1]), (3, rows[3][1])]


@pytest.mark.parametrize("chunk,hot,low,depth", [(2000, 1 << 20, 2, 4), (6 << 20, 1 << 20, 3, 2), (2000, 25, 2, 4), (6 << 20, 8, 2, 1), (2000, 2, 2, 5)])
def test_matches_dictionaries(spark, chunk, hot, low, depth):
    rows = docs(1)
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    params = TreeParams(depth=depth, min_context=low, chunk_bytes=chunk, hot=hot)
    got = score(spark.createDataFrame(rows, "doc_id long, text string"), remainder("doc_id", 7) != 2, params).collect()
    want = sorted(Brute(rows, train, low, depth).score(rows))
    have = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.n_deep) for r in got)
    assert [w[:4] for w in want] == [h[:4] for h in have] and (depth == 1 or sum(w[6] for w in want) > 50)
    assert [h[4] for h in have] == pytest.approx([w[4] for w in want])
    assert [h[5] for h in have] == pytest.approx([w[5] for w in want], rel=1e-6)
    assert [h[6] for h in have] == [w[6] for w in want]


def test_probabilities_add_up(spark):
    """After each kept context the operator's probabilities of all words and of one that is unseen add up to one."""
    rows = docs(2)
    tree = Brute(rows, [True] * len(rows), 2, 4)
    vocab = [g[0] for g in tree.count if len(g) == 1 and g[0] != END] + ["unseen-word"]
    kept = [c for c, k in tree.types.items() if k and c[0] != START]
    chosen = [c for k in range(1, 5) for c in sorted(c for c in kept if len(c) == k)[:: max(1, len(kept) // 12)]]
    assert {len(c) for c in chosen} == {1, 2, 3, 4}
    asked = [" ".join(c) + tail for c in chosen for tail in ("", *(" " + t for t in vocab))]
    table = [(i, x, True) for i, x in rows] + [(10_000 + k, x, False) for k, x in enumerate(asked)]
    out = score(spark.createDataFrame(table, "doc_id long, text string, learn boolean"), F.col("learn"), TreeParams(hot=40))
    got = {r.doc_id - 10_000: r.score for r in out.collect()}
    end = math.log10
    step = len(vocab) + 1
    for j, ctx in enumerate(chosen):
        total = 0.0
        before = sum(end(tree.prob(*c)) for c in tree.contexts(" ".join(ctx))[:-1])
        for k in range(step):
            text = asked[j * step + k]
            rest = 0.0 if k == 0 else end(tree.prob(*tree.contexts(text)[-1]))  # of the end after a further word
            total += 10 ** (got[j * step + k] - before - rest)
        assert total == pytest.approx(1, abs=1e-5)


def test_held_out_beats_single_words(spark):
    rows = docs(3, 400)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = score(df, remainder("doc_id", 7) != 2, TreeParams(min_context=4)).where(remainder("doc_id", 7) == 2)
    a, b = out.agg(F.sum("score"), F.sum("base_score")).first()
    assert a > b


def test_odd_tables(spark):
    schema = "doc_id long, text string, n_tokens int, score string"
    assert score(spark.createDataFrame([], schema), F.lit(True)).collect() == []
    out = score(spark.createDataFrame([(None, "a b", 1, ""), (None, None, 2, None)], schema), remainder("doc_id", 7) != 2).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in out} == {(None, 3, 0, 0), (None, 1, 0, 0)}


def test_very_long_text(spark):
    words = ["a b c d e"] * 100_000 + ["one two three"]
    rows = [(1, " ".join(words)), (2, "a b c d e a b"), (2, "a b c d e a b"), (4, "x" * 300_000)]
    out = {r.doc_id: r for r in score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), TreeParams(hot=50_000, chunk_bytes=1 << 16)).collect()}
    assert out[1].n_tokens == 500_004 and out[2].n_tokens == 8 and out[4].n_tokens == 2
    assert out[1].score > out[1].base_score / 10


def test_query_learns_passages_that_few_documents_share(spark, tmp_path):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdef", k=3)) for _ in range(40)]
    plain = lambda n: " ".join(rng.choices(words, k=n))
    passages = [plain(30) for _ in range(6)]
    rows = [(i, f"{plain(30)} {passages[i % 6] if i < 36 else plain(30)} {plain(30)}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    total = lambda df: {r.doc_id: r.score for r in df.collect() if r.doc_id < 36 and zlib.crc32(str(r.doc_id).encode()) % 7 == 2}
    deep = total(QUERIES["op1_suffix_tree"](spark, str(tmp_path)))
    shallow = total(score(spark.read.parquet(f"{tmp_path}/documents.parquet"), remainder("doc_id", 7) != 2, TreeParams(depth=2, min_context=16)))
    assert len(deep) > 2 and all(deep[i] > shallow[i] + 10 for i in deep)
