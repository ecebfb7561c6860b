import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from voxspark.llm.cuckoo import KEY, CuckooFilter
from voxspark.llm.line_dedup import LineIndex, LineParams, Shard, digest, drop_repeated_lines

SCHEMA = "doc_id long, text string, kept string, n_lines int, chunk long"
BLANK = " \t\n\v\f\r"
SMALL = LineParams(chunk_bytes=3000, shard_bytes=2000, least_shards=2, message=4)


def key(line):
    k = line.strip(BLANK)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in k) if len(k) >= 10 else None


def brute(rows):
    """What stays of each row, rows as (doc_id, text, ...)."""
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if (k := key(line)) is not None:
                first[k] = min(first.get(k, order(i)), order(i))
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) is None or first[key(line)] == order(i)]
        out.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in digest(df).collect())


def corpus(seed, n=120, first=0):
    rng = random.Random(seed)
    lines = ["".join(rng.choices("abCDé中 \t", k=rng.randint(0, 25))) for _ in range(150)] + ["all rights reserved", "ééééé中中中中中", "123456789", "1234567890", " 123456789é ", "\r"]
    odds = [1 / (i + 1) for i in range(len(lines))]
    pick = lambda: "".join(rng.choice((c, c.upper() if c.isascii() else c)) for c in rng.choices(lines, odds)[0])
    texts = ["\n".join([*(pick() for _ in range(rng.randint(0, 12))), rng.choice(["All Rights reserved", " all rights reserved\r", f"own line {rng.random()}"])]) for _ in range(n)]
    texts += ["", None, "\n\n", "\n".join(pick() for _ in range(3000)), "x" * 50_000, "X" * 50_000, "same line here\nsame line here"]
    rng.shuffle(texts)
    rows = [(first + i if i % 40 else None, t, "k", 1, 2) for i, t in enumerate(texts)]
    return rows + [(first + 5, rows[5][1], "", 0, 0), (first + 6, rows[7][1], "", 0, 0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("seed,params", [(1, LineParams()), (2, SMALL), (3, LineParams(least_shards=1))])
def test_against_brute_force(spark, seed, params):
    rows = corpus(seed)
    assert result(drop_repeated_lines(frame(spark, rows), params=params)) == brute(rows)


def test_insertions_and_deletions(spark):
    """States of the index follow its documents; earlier states stay as they were."""
    a, b = corpus(4, 60), corpus(4, 60, first=100)
    rng = random.Random(7)
    empty = LineIndex.empty(spark, SMALL)
    assert empty.deduplicated().collect() == [] and empty.delete(frame(spark, a)).deduplicated().collect() == []
    one = empty.insert(frame(spark, b))
    two = one.insert(frame(spark, a))
    assert two.n_shards > 2 and result(two.deduplicated()) == brute(a + b)
    out = set(rng.sample(range(170), 60)) | {5, 6, 7, 100}
    ids = spark.createDataFrame([(i,) for i in out] + [(None,), (10**9,), (5,)], "doc_id long")
    left = [r for r in a + b if r[0] is None or r[0] not in out]
    three = two.delete(ids)
    assert result(three.deduplicated()) == brute(left)
    again = corpus(5, 30, first=1000)
    four = three.insert(frame(spark, again))
    assert result(four.deduplicated()) == brute(left + again)
    more = {r[0] for r in again if r[0] and r[0] % 2} | {8, 9, 110}
    five = four.delete(spark.createDataFrame([(i,) for i in more | out], "doc_id long"))
    left = [r for r in left + again if r[0] is None or r[0] not in more]
    assert result(five.deduplicated()) == brute(left)
    assert result(two.deduplicated()) == brute(a + b)
    # the filters hold the keys of what is left
    held = {k for r in left for line in (r[1] or "").split("\n") if (k := key(line)) is not None}
    shards = [Shard(r.asDict()) for r in five.shards.collect()]
    assert sum(s.filter.count for s in shards) == len(held) == sum(len(np.unique(s.keys)) for s in shards)
    assert all(s.filter.contains(s.keys).all() for s in shards)
    nothing = five.delete(spark.createDataFrame([(r[0],) for r in left if r[0]], "doc_id long"))
    assert result(nothing.deduplicated()) == brute([r for r in left if r[0] is None])


def test_no_rows(spark):
    assert drop_repeated_lines(spark.createDataFrame([], SCHEMA)).collect() == []
    assert result(drop_repeated_lines(frame(spark, [(None, None, "", 0, 0)]))) == brute([(None, None)])


def random_keys(rng, n):
    return np.frombuffer(rng.bytes(16 * n), dtype=KEY)


def test_filter():
    rng = np.random.default_rng(1)
    keys = np.unique(random_keys(rng, 60_000))
    f = CuckooFilter(len(keys))
    for part in np.array_split(keys, 7):
        f.insert(part)
    assert f.contains(keys).all() and f.count == len(keys)
    others = random_keys(rng, 100_000)
    assert f.contains(others).mean() < 0.001
    f = CuckooFilter.from_bytes(f.to_bytes())
    f.delete(keys[::2])
    assert f.contains(keys[1::2]).all() and f.contains(keys[::2]).mean() < 0.001
    f.delete(keys[1::2])
    assert not f.slots.any() and not len(f.over) and f.count == 0


def test_filter_with_equal_fingerprints():
    """More keys than two buckets hold, all with one fingerprint and one pair of buckets."""
    words = np.zeros((40, 2), dtype="<u8")
    words[:, 0] = np.arange(1, 41, dtype=np.uint64)  # the fingerprint's bits are all zero
    keys = np.frombuffer(words.tobytes(), dtype=KEY)
    f = CuckooFilter(100)
    f.insert(keys)
    assert f.contains(keys).all() and len(f.over) >= 32
    f = CuckooFilter.from_bytes(f.to_bytes())
    f.delete(keys[:39])
    assert f.contains(keys[39:]).all() and f.count == 1
    f.delete(keys[39:])
    assert not f.contains(keys).any()


def test_shard_looks_up_only_what_the_filter_knows():
    rng = np.random.default_rng(2)
    keys = np.unique(random_keys(rng, 5000))
    one = lambda k, c: (k, np.full(len(k), c), np.ones(len(k), dtype=np.int64), np.full(len(k), c))
    shard = Shard()
    assert shard.insert([one(keys[:3000], 1)]) < 30
    assert 1000 <= shard.insert([one(keys[2000:], 2)]) < 1030
    assert Counter(np.unique(shard.keys, return_counts=True)[1].tolist()) == {1: 4000, 2: 1000}
    assert shard.filter.count == 5000 and sum(len(k) // 16 for k in shard.replies()["keys"]) == 1000
