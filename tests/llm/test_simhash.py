import random

import numpy as np
import pytest
import xxhash

from voxspark.operators.components import connected, local_roots
from voxspark.scratch import Scratch
from voxspark.llm.simhash import SimhashParams, fingerprint, near_duplicates, near_links, trie_pairs

U = np.uint64


def components(n, links):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return [root(i) for i in range(n)]


def slow_fingerprint(text: str) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 50, 700):
        text = "".join(rng.choice("aBÉ \t\n \u0085z") for _ in range(n * 4))
        assert fingerprint(text.encode()) == slow_fingerprint(text)


def near_values(rng, n):
    base = [rng.getrandbits(64) for _ in range(n)]
    return np.array(sorted({v ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (2**64 - 1) for v in base for _ in range(6)} | set(base) | {0, 2**64 - 1, 1, 3, 1 << 63}), dtype=U)


def test_trie_pairs():
    rng = random.Random(2)
    for n in (1, 3, 40):
        v = near_values(rng, n)
        i, j = trie_pairs(v, [0], [len(v)], [0], [len(v)], 0, [0])
        want = {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if int(v[a] ^ v[b]).bit_count() <= 2}
        assert set(zip(i.tolist(), j.tolist())) == want
    v = np.arange(3000, dtype=U)  # dense: far more than a comparison block
    i, j = trie_pairs(v, [0], [len(v)], [0], [len(v)], 40, [0])
    d = np.bitwise_count(v[:, None] ^ v[None, :])
    assert len(set(zip(i.tolist(), j.tolist()))) == int(((d <= 2).sum() - len(v)) // 2)


def test_descent_from_the_root(spark):
    """The walk from the root, with no budget in the first third, finds every pair that agrees there."""
    rng = random.Random(8)
    v = near_values(rng, 300)
    visits = {}
    i, j = trie_pairs(v, [0], [len(v)], [0], [len(v)], 0, [0], 22, visits)
    want = {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if int(v[a] ^ v[b]).bit_count() <= 2 and int(v[a] ^ v[b]) < 1 << 42}
    assert set(zip(i.tolist(), j.tolist())) == want
    assert visits["inner"] > len(v) and visits["leaves"] < 20 * len(v)  # pruned: not all pairs of leaves


def test_local_roots():
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    a, b = map(np.array, zip(*links))
    got = dict(zip(*(x.tolist() for x in local_roots(a, b))))
    assert [got.get(i, i) for i in range(200)] == components(200, links)


@pytest.mark.parametrize("hot,subtree", [(50_000, 20_000), (3, 20_000), (50_000, 30), (20, 5)])
def test_near_links_and_components(spark, hot, subtree):
    v = near_values(random.Random(4), 60)
    v = np.unique(np.concatenate([v, np.arange(300, dtype=U)]))
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    scratch = Scratch(spark, "test")
    got = {r.node: r.component for r in connected(near_links(df, SimhashParams(hot_node=hot, subtree=subtree)), scratch).collect()}
    d = np.bitwise_count(v[:, None] ^ v[None, :])
    label = components(len(v), [(a, b) for a, b in zip(*np.nonzero(d <= 2)) if a < b])
    classes = lambda keys: {frozenset(i for i, k in enumerate(keys) if k == x) for x in set(keys)}
    s = v.view(np.int64).tolist()
    assert classes([got.get(x, x) for x in s]) == classes(label)
    scratch.clear()


def test_whole_node_after_hot_node_in_one_partition(spark):
    rng = random.Random(6)
    n, low = 5, lambda k: rng.getrandbits(k)
    hot = [((n - 1) << 42) | (63 << 36) | low(36) for _ in range(100)]  # reaches the last pair of sub-nodes
    one = [(n << 42) | low(42) for _ in range(30)]
    other = [v ^ (1 << rng.randrange(36, 42)) ^ (1 << rng.randrange(21)) for v in one]  # only the first trie meets them
    v = np.array(sorted({*hot, *one, *other}), dtype=U)
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        links = {tuple(sorted((r.a, r.b))) for r in near_links(df, SimhashParams(hot_node=80)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {tuple(sorted(p)) for p in zip(one, other)} <= links


def test_long_chain(spark):
    rng = random.Random(5)
    ids = rng.sample(range(10_000), 500)
    df = spark.createDataFrame(list(zip(ids, ids[1:])) + [(None, 3), (7, 7)], "a long, b long")
    got = connected(df, Scratch(spark, "test")).collect()
    assert {r.component for r in got} == {min(ids)} and len(got) == 499


def test_documents(spark):
    rows = [(1, "a b c d"), (2, "A  b\tc d"), (3, None), (4, " \n"), (5, "x"), (None, "x"), (6, "q r s t u v"), (1, "a b c d"), (0, "")]
    got = {(r.doc_id, r.component_id, r.fp == 0) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, 1, False), (2, 1, False), (3, 0, True), (4, 0, True), (0, 0, True), (5, 5, False), (None, 5, False), (6, 6, False)} == got
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).collect() == []
