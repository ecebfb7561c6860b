import math
import random

import numpy as np
from pyspark.sql import functions as F

from voxspark.llm.pstable import PStableParams, near_vectors
from voxspark.llm.topk import TopKParams, top_products

from .test_simhash import components

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)


def table(seed, n=150, dim=8):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim)).astype(np.float32)
    rows = [b.tolist() for b in base]
    for b in base[:40]:
        rows += [(b * 3).tolist(), (b + 0.12 * rng.standard_normal(dim)).astype(np.float32).tolist(), b.tolist()]
    rows += [(base[0] + 0.02 * rng.standard_normal(dim)).astype(np.float32).tolist() for _ in range(60)]
    rows += [None, [], [0.0] * dim, [1.0] * (dim - 1) + [None], [1.0] * (dim - 1) + [math.nan], [math.inf] + [1.0] * (dim - 1), [1.0, 2.0], [1.0, 2.0]]
    random.Random(seed).shuffle(rows)
    return [(i if i != 3 else None, r, i % 3) for i, r in enumerate(rows)] + [(5, rows[5], 0), (5, rows[6], 0)]


def links(rows, threshold=0.95):
    ok = [i for i, r in enumerate(rows) if usable(r[1]) and any(r[1])]
    for a in ok:
        for b in ok:
            x, y = rows[a][1], rows[b][1]
            if a != b and len(x) == len(y):
                x, y = np.array(x, dtype=float), np.array(y, dtype=float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    yield a, b


def expected(rows):
    pairs = list(links(rows))
    label = components(len(rows), pairs)
    low = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in label}
    count = np.bincount([a for a, _ in pairs], minlength=len(rows))
    return sorted(((r[0] is None, r[0] or 0), int(n), low[c]) for r, n, c in zip(rows, count, label))


def test_near_vectors(spark):
    for seed, hot, share in ((1, 4096, 1000), (2, 7, 50), (3, 7, 1)):
        rows = table(seed)
        out = near_vectors(spark.createDataFrame(rows, SCHEMA), params=PStableParams(hot_cell=hot, hot_share=share)).collect()
        assert sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id) for r in out) == expected(rows)
        assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in out)


def test_chance_of_a_miss():
    p = PStableParams()
    for n in (10, 10_000, 10**9):
        k, tables = p.shape(n)
        assert (1 - p.meets(math.sqrt(0.1)) ** k) ** tables <= p.miss


def test_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_vectors(empty).collect() == []
    assert top_products(empty, F.col("vec_id") % 100 == 0).collect() == []


def brute_top(rows, is_query, k):
    whole = [[math.floor(1024 * x) for x in r[1]] if usable(r[1]) else None for r in rows]
    out = []
    for q, r in enumerate(rows):
        if whole[q] is None or r[0] is None or not is_query(r[0]):
            continue
        found = [(-sum(a * b for a, b in zip(whole[q], w)), rows[i][0] if rows[i][0] is not None else 2**63) for i, w in enumerate(whole) if w is not None and i != q and len(w) == len(whole[q])]
        out += [(r[0], rank, v if v != 2**63 else None, -s) for rank, (s, v) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def test_top_products(spark):
    for seed, params in ((3, TopKParams()), (4, TopKParams(block_bytes=400, dims=2)), (5, TopKParams(k=1000))):
        rows = table(seed)
        got = top_products(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0, params=params).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_top(rows, lambda i: i % 5 == 0, params.k)


def test_large_components(spark):
    rows = [(i, [float((i * 37 + d) % 11) * 1e5 + 0.25 for d in range(4)], 0) for i in range(40)]
    got = top_products(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_top(rows, lambda i: i % 5 == 0, 10)


def test_components_whose_products_overflow(spark):
    rng = random.Random(6)
    for top in (1e7, 1e10, 1e14, 1e300):
        rows = [(i, [rng.uniform(-top, top) for _ in range(6)], 0) for i in range(60)] + [(100 + i, [rng.uniform(-1, 1) for _ in range(6)], 0) for i in range(20)]
        got = top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 5 == 0, params=TopKParams(block_bytes=400, dims=2)).collect()
        clip = lambda x: max(-(2**63), min(2**63 - 1, x))
        whole = [[int(float(clip(math.floor(1024 * x)))) for x in r[1]] for r in rows]
        want = []
        for q, r in enumerate(rows):
            if r[0] % 5 == 0:
                found = [(-clip(sum(a * b for a, b in zip(whole[q], w))), rows[i][0]) for i, w in enumerate(whole) if i != q]
                want += [(r[0], rank, v, -s) for rank, (s, v) in enumerate(sorted(found)[:10], 1)]
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_other_columns_with_clashing_names(spark):
    rows = [(i, [float(i), 1.0], 1, 2, "x", 3) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, component_id int, key string, v int")
    assert top_products(df, F.col("vec_id") % 5 == 0).columns == ["query_id", "rank", "vec_id", "score"] and near_vectors(df).count() == 12
