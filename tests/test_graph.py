"""Graph operators against plain sequential programs."""

import math
import random
import tracemalloc
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxspark.operators import graph as G
from voxspark.operators.neighbors import boundaries, neighbours
from voxspark.operators.lines import _edge, envelope, nearest_labels
from voxspark.operators.region import edt


def volume(spark, a, name="V", column="label"):
    rows = [(name, *map(int, i), int(v)) for i, v in np.ndenumerate(a) for i in [i]]
    return spark.createDataFrame(rows, f"volume string, z int, y int, x int, {column} long")


def back(df, shape, column):
    out = np.zeros(shape, dtype=np.int64)
    for r in df.collect():
        out[r.z, r.y, r.x] = r[column]
    return out


def bfs(a, steps):
    label, n = np.zeros(a.shape, np.int64), 0
    for i in np.ndindex(a.shape):
        if a[i] and not label[i]:
            n += 1
            todo = [i]
            label[i] = n
            while todo:
                j = todo.pop()
                for s in steps:
                    k = tuple(p + q for p, q in zip(j, s))
                    if all(0 <= p < m for p, m in zip(k, a.shape)) and a[k] == a[j] and not label[k]:
                        label[k] = n
                        todo.append(k)
    return label


@pytest.mark.parametrize("connectivity,block", [(1, (2, 3, 4)), (3, (3, 2, 2)), (2, (32, 32, 32))])
def test_components(spark, connectivity, block):
    a = np.random.default_rng(connectivity).integers(0, 3, (5, 7, 9))
    want = bfs(a, neighbours(connectivity))
    got = back(G.label_components(volume(spark, a), connectivity=connectivity, block=block), a.shape, "component")
    assert np.array_equal(got, want)
    small = Counter(want.ravel())
    got = back(G.label_components(volume(spark, a), connectivity=connectivity, min_voxels=4, block=block), a.shape, "component")
    assert np.array_equal(got, np.where(np.vectorize(small.get)(want) >= 4, want, 0))


def test_snake_through_blocks(spark):
    a = np.zeros((1, 9, 9), int)
    a[0, ::2], a[0, 1::4, -1], a[0, 3::4, 0] = 1, 1, 1
    got = back(G.label_components(volume(spark, a), block=(1, 2, 2)), a.shape, "component")
    assert set(got[a > 0]) == {1}


def watershed(n, edges):
    """Mutex Watershed by the definition: every pair of clusters has its bans in one set."""
    label, bans = list(range(n)), set()
    for u, v, push in edges:
        a, b = label[u], label[v]
        if a == b:
            continue
        if push:
            bans |= {(a, b), (b, a)}
        elif (a, b) not in bans:
            label = [a if x == b else x for x in label]
            bans = {(a if p == b else p, a if q == b else q) for p, q in bans}
    return label


def same(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def graph(seed, n=60):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.choice([0.1, 0.3, 0.5, 0.7, rng.random()]), k % 5, rng.random() < 0.4) for k in range(400)]


def test_mutex_watershed(spark):
    groups = {s: [e for e in graph(s) if e[0] != e[1]] for s in range(6)}
    edges = spark.createDataFrame([(s, *e) for s, es in groups.items() for e in es], "sample_id int, u long, v long, w double, off int, is_mutex boolean")
    edges = edges.dropDuplicates(["sample_id", "u", "off", "w"])
    nodes = spark.createDataFrame([(s, i) for s in groups for i in range(60)], "sample_id int, node long")
    got = G.mutex_watershed(edges, nodes, ["sample_id"]).collect()
    for s in groups:
        es = sorted((r for r in edges.where(F.col("sample_id") == s).collect()), key=lambda r: (-r.w, r.off, r.u))
        want = watershed(60, [(r.u, r.v, r.is_mutex) for r in es])
        have = [r.label for r in sorted((r for r in got if r.sample_id == s), key=lambda r: r.node)]
        assert same(have, want) and set(have) == set(range(1, len(set(have)) + 1))
    with pytest.raises(Exception, match="smaller"):
        G.mutex_watershed(edges, nodes, ["sample_id"], max_edges=10).collect()


def test_agglomerate_caps_each_crop(spark):
    offsets, n_pull, k = [(-1, 0, 0), (0, -1, 0), (0, 0, -1), (0, -2, 0), (0, 0, -2)], 3, 6
    shape, rng = (2, 5, 6), np.random.default_rng(8)
    crops = {s: rng.random((*shape, len(offsets))).round(2) for s in range(4)}
    crops[0][..., n_pull:] *= 0.1  # its push edges outweigh those of all other crops
    rows = [(s, *map(int, i), a[i].tolist()) for s, a in crops.items() for i in np.ndindex(shape)]
    df = spark.createDataFrame(rows, "sample_id int, z int, y int, x int, aff array<double>")
    got = G.agglomerate(df, offsets, n_pull, strides=(1, 1, 1), max_push_edges=k, by=["sample_id"]).collect()
    flat = lambda i: (int(i[0]) * shape[1] + int(i[1])) * shape[2] + int(i[2])
    for s, a in crops.items():
        edges = []
        for i in np.ndindex(shape):
            for o, d in enumerate(offsets):
                j = tuple(p + q for p, q in zip(i, d))
                if all(0 <= p < n for p, n in zip(j, shape)):
                    w = float(np.float32(1) - np.float32(a[i][o])) if o >= n_pull else float(np.float32(a[i][o]))
                    edges.append((-w, o, flat(i), flat(j)))
        edges.sort()
        push = [e for e in edges if e[1] >= n_pull]
        assert len(push) > k  # the cap binds
        kept = [e for e in edges if e[1] < n_pull or e in push[:k]]
        want = watershed(int(np.prod(shape)), [(u, v, o >= n_pull) for _, o, u, v in kept])
        have = [r.label for r in sorted((r for r in got if r.sample_id == s), key=lambda r: (r.z, r.y, r.x))]
        assert same(have, want)


def rounds(n, edges, buckets):
    """The bucketed method edge by edge, with sets."""
    group, bans = list(range(n)), set()
    for k in range(buckets):
        part = edges[len(edges) * k // buckets : len(edges) * (k + 1) // buckets]
        while True:
            pairs = [(min(group[u], group[v]), max(group[u], group[v]), m) for u, v, m in part]
            bans |= {(a, b) for a, b, m in pairs if m and a != b}
            to = {}
            for a, b, m in pairs:
                if a != b and not m and (a, b) not in bans:
                    to.setdefault(b, a)
            if not to:
                break

            def end(g, to=to):
                return end(to[g]) if g in to else g

            group = [end(g) for g in group]
            bans = {(min(end(a), end(b)), max(end(a), end(b))) for a, b in bans if end(a) != end(b)}
    return group


def random_graph(seed, n, m):
    rng = np.random.default_rng(seed)
    u, v = rng.integers(0, n, m), rng.integers(0, n, m)
    return u[u != v], v[u != v], rng.random(int((u != v).sum())) < 0.4


@pytest.mark.parametrize("seed", range(60))
def test_bucketed_rounds(seed):
    n = 2 + seed
    u, v, push = random_graph(seed, n, seed * 4)
    for buckets in (1, 3, 16):
        assert G.mutex_rounds(u, v, push, n, buckets).tolist() == rounds(n, list(zip(u.tolist(), v.tolist(), push.tolist())), buckets)
    exact = G.mutex_core(u, v, push, n)
    assert same(G.mutex_rounds(u, v, push, n, max(1, len(u))), exact)  # one edge a bucket
    assert same(G.mutex_rounds(u, v, push, n, 10 * len(u) + 1), exact)


def test_bucketed_crops(spark):
    rng = np.random.default_rng(5)
    a = rng.random((2, 3, 5, 6, 4))
    offsets = [(-1, 0, 0), (0, -1, 0), (0, 0, -1), (0, -2, 0)]
    rows = [(s, z, y, x, a[s, z, y, x].tolist(), "clash") for s, z, y, x in product(range(2), range(3), range(5), range(6))]
    df = spark.createDataFrame(rows, "sample_id int, z int, y int, x int, aff array<double>, label string")
    cut = lambda method, buckets: sorted(map(tuple, G.agglomerate(df, offsets, 3, strides=(1, 1, 1), by=["sample_id"], method=method, buckets=buckets).collect()))
    exact = cut("exact", 16)
    assert cut("bucketed", 10_000) == exact  # labels are numbered alike
    assert cut("bucketed", 4) != exact
    assert not G.agglomerate(df.limit(0), offsets, 3, by=["sample_id"], method="bucketed").collect()
    with pytest.raises(ValueError):
        cut("other", 16)
    with pytest.raises(ValueError):
        cut("bucketed", 0)


def test_bucketed_respects_strong_bans(spark):
    edges = spark.createDataFrame([(0, 1, 0.9, 0, False), (1, 2, 0.8, 0, False), (0, 2, 0.95, 1, True), (3, 4, 0.2, 0, False)], "u long, v long, w double, off int, is_mutex boolean")
    nodes = spark.range(6).withColumnRenamed("id", "node")
    got = {r.node: r.root for r in G.mutex_bucketed(edges, nodes, 4).collect()}
    assert got[0] == got[1] and got[2] != got[0] and got[3] == got[4] and got[5] == 5


def test_stitch(spark):
    rows = [(c, n, 1 if n < 6 else 2) for c, lo in ((0, 0), (1, 4), (2, 8)) for n in range(lo, lo + 6)]
    got = {r.node: r.label for r in G.stitch(spark.createDataFrame(rows, "crop int, node long, label long")).collect()}
    assert len({got[n] for n in range(6)}) == 1 and len({got[n] for n in range(6, 14)}) == 1 and got[0] != got[7]


def test_relabel_filter_grow(spark):
    a = np.array([[[0, 7, 7, 0, 0, 9], [0, 0, 7, 0, 0, 0]]])
    df = volume(spark, a)
    assert np.array_equal(back(G.relabel_consecutive(df), a.shape, "label"), np.where(a == 7, 1, np.where(a == 9, 2, 0)))
    assert np.array_equal(back(G.size_filter(df, 2), a.shape, "label"), (a == 7).astype(int))
    assert np.array_equal(back(G.size_filter(df, 1), a.shape, "label"), a)
    grown = back(G.grow_labels(df, max_distance=1), a.shape, "label")
    assert grown.tolist() == [[[7, 7, 7, 7, 9, 9], [0, 7, 7, 7, 0, 9]]]


def test_edt(spark):
    a = np.random.default_rng(3).integers(0, 4, (3, 5, 6)) > 0
    zeros = np.argwhere(~a)
    want = np.array([np.sqrt((((np.array(i) - zeros) * [2.0, 1.0, 0.5]) ** 2).sum(1).min()) for i in np.ndindex(a.shape)])
    got = sorted((r.z, r.y, r.x, r.distance) for r in edt(volume(spark, a).withColumn("m", F.col("label") > 0), "m", (2.0, 1.0, 0.5)).collect())
    assert np.allclose([g[3] for g in got], want)


def test_edt_long_lines(spark):
    """Lines of 20,000 voxels: a matrix of a line with itself would need 3 GB."""
    n, rng = 20_000, np.random.default_rng(5)
    zeros = {y: np.sort(rng.choice(n, 20 * y, replace=False)) for y in range(3)}  # none in the first line
    rows = spark.range(3 * n).select(F.lit("V").alias("volume"), (F.col("id") % n).cast("int").alias("z"), F.floor(F.col("id") / n).cast("int").alias("y"), F.lit(0).alias("x"))
    at = spark.createDataFrame([(int(z), y) for y, s in zeros.items() for z in s], "z int, y int").withColumn("zero", F.lit(True))
    df = rows.join(at, ["z", "y"], "left").select("volume", "z", "y", "x", F.col("zero").isNull().alias("m"))
    got = edt(df, "m", (2.0, 1000.0, 1.0), block=(2048, 4, 4)).toPandas().sort_values(["y", "z"])["distance"].to_numpy().reshape(3, n)
    far = {y: np.abs(np.arange(n)[:, None] - s[None, :]).min(1, initial=n) * 2.0 for y, s in zeros.items()}
    for y in range(3):
        want = np.min([np.sqrt(far[k] ** 2 + (1000.0 * (y - k)) ** 2) for k in (1, 2)], axis=0)
        assert np.allclose(got[y], want)


@pytest.mark.parametrize("mode", ["inner", "outer", "thick"])
def test_boundaries_any_block(spark, mode):
    a = np.random.default_rng(4).integers(0, 3, (4, 5, 6))
    pad = np.pad(a, 1, mode="edge")
    around = [pad[1 + z : 5 + z, 1 + y : 6 + y, 1 + x : 7 + x] for z, y, x in neighbours(3)]
    differs = np.any([n != a for n in around], axis=0)
    touch = np.any([(n != a) & (n != 0) & (a != 0) for n in around], axis=0)
    want = {"inner": differs & (a > 0), "outer": differs & ((a == 0) | touch), "thick": differs}[mode]
    for block in ((2, 2, 3), (32, 64, 64)):
        got = back(boundaries(volume(spark, a), mode=mode, connectivity=3, block=block), a.shape, "boundary")
        assert np.array_equal(got.astype(bool), want)


def test_errors(spark):
    df = volume(spark, np.ones((1, 2, 2)))
    with pytest.raises(ValueError):
        boundaries(df, mode="no")
    assert list(product([0], neighbours(1, True)))[0][1][0] == 0


@pytest.mark.parametrize("step", [1.0, 1.5, 3.0])
def test_envelope(step):
    """Lowest costs, and of equal ones the first place, for many lines at once."""
    rng, n = np.random.default_rng(6), 120
    cost = np.where(rng.random((300, n)) < rng.random((300, 1)) ** 3, rng.integers(0, 12, (300, n)) ** 2.0, math.inf)
    cost[:3] = math.inf
    cost[3] = 0
    best, source = envelope(cost, step)
    i = np.arange(n)
    every = cost[:, None, :] + (step * (i[:, None] - i[None, :])) ** 2
    assert np.array_equal(best, every.min(axis=2))
    assert np.array_equal(source, np.where(np.isfinite(best), every.argmin(axis=2), -1))


def test_envelope_memory():
    rng, n = np.random.default_rng(6), 3000
    cost = np.where(rng.random((1, n)) < 0.02, rng.integers(0, 50, (1, n)) ** 2.0, math.inf)
    tracemalloc.start()
    envelope(cost, 1.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2000 * n and _edge(10**9) == 1


def grown(a, sampling, limit=math.inf):
    """Each place's label by looking at all labelled places; ties to the first."""
    at = np.argwhere(a)
    out = a.copy()
    for i in np.argwhere(a == 0):
        if len(at):
            far = (((at - i) * sampling) ** 2).sum(axis=1)
            k = far.argmin()
            out[tuple(i)] = a[tuple(at[k])] if far[k] <= limit**2 else 0
    return out


@pytest.mark.parametrize("share,sampling", [(0.02, (1.0, 1.0, 1.0)), (0.2, (2.0, 1.0, 1.0)), (0.005, (3.0, 2.0, 1.0)), (0, (1.0, 1.0, 1.0))])
def test_growth(spark, share, sampling):
    rng = np.random.default_rng(12)
    a = np.where(rng.random((7, 11, 13)) < share, rng.integers(1, 9, (7, 11, 13)), 0)
    b = np.where(rng.random((3, 5, 4)) < 0.1, rng.integers(1, 9, (3, 5, 4)), 0)
    both = volume(spark, a).unionByName(volume(spark, b, "W"))
    for limit in (0, -1, 2.5, 4):
        got = G.grow_labels(both, max_distance=limit, sampling=sampling, block=(3, 4, 5))
        for name, v in (("V", a), ("W", b)):
            assert np.array_equal(back(got.where(F.col("volume") == name), v.shape, "label"), grown(v, sampling, limit if limit > 0 else math.inf))
    assert np.array_equal(np.where(a == 0, nearest_labels(a, sampling)[1], a), grown(a, sampling))


def test_stored_blocks_stay(spark, tmp_path):
    """Operators on a stored volume exchange rims of blocks, and no voxel rows."""
    from voxspark.operators.neighbors import affinities, shift
    from voxspark.sources.arrays import read_volume, write_volume

    a = np.random.default_rng(13).integers(0, 3, (5, 9, 8))
    df, block = volume(spark, a), (2, 4, 4)
    write_volume(df, ["label"], f"file://{tmp_path}/v", block)
    stored = read_volume(spark, f"file://{tmp_path}/v", {"label": "bigint"}, block)
    for fn in (lambda d: boundaries(d, block=block), lambda d: shift(d, (1, -2, 1), "label", block=block), lambda d: affinities(d, [(-1, 0, 0), (0, 2, -3)], block=block),
               lambda d: G.grow_labels(d, block=block), lambda d: G.grow_labels(d, max_distance=0, block=block)):
        plan = fn(stored)._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange" in line]
        assert moved and all("bz" in line or "ca" in line for line in moved), plan
        assert sorted(map(str, fn(stored).collect())) == sorted(map(str, fn(df).collect()))
    got = G.label_components(stored, block=block)
    assert np.array_equal(back(got, a.shape, "component"), bfs(a, neighbours(1)))
    with pytest.raises(ValueError, match="blocks are"):
        boundaries(stored)


def test_blocks_of_many_volumes(spark):
    """Components are numbered over all volumes; null volumes are volumes."""
    rng = np.random.default_rng(14)
    parts = {name: rng.integers(0, 2, (2, 3, 3)) for name in ("a", "b", None)}
    df = None
    for name, a in parts.items():
        one = volume(spark, a, name or "").withColumn("volume", F.lit(name).cast("string"))
        df = one if df is None else df.unionByName(one)
    got = G.label_components(df, block=(1, 2, 2)).collect()
    for name, a in parts.items():
        mine = {(r.z, r.y, r.x): r.component for r in got if r.volume == name}
        assert same([mine[i] for i in np.ndindex(a.shape)], bfs(a, neighbours(1)).ravel().tolist())
    ids = {r.component for r in got if r.component}
    assert ids == set(range(1, len(ids) + 1)) and len(ids) == sum(bfs(a, neighbours(1)).max() for a in parts.values())


@pytest.mark.parametrize("by", [(), ("crop",)])
def test_push_edges_by_selection(spark, by):
    from voxspark.operators.neighbors import cap_push_edges

    rng = random.Random(3)
    rows = {(c, u, off): (c, u, u + 1, rng.choice([0.0, 1.0, 1.0, 0.5, round(rng.random(), 3)]), off, off > 0) for c in (1, 2, None) for u in range(150) for off in range(4) if rng.random() < (0.9 if c == 1 else 0.3)}
    rows = list(rows.values())
    df = spark.createDataFrame(rows, "crop int, u long, v long, w double, off int, is_mutex boolean").repartition(4)
    crops = {r[0] for r in rows} if by else {"all"}
    for k in (0, 1, 30, 117, 10_000):
        want = [r for r in rows if not r[5]]
        for c in crops:
            push = sorted((r for r in rows if r[5] and (not by or r[0] == c)), key=lambda r: (-r[3], r[4], r[1], str(r[0])))
            want += push[:k]
        got = [tuple(r) for r in cap_push_edges(df, k, by, bins=16).collect()]
        if by:
            assert sorted(map(str, got)) == sorted(map(str, want))
        else:  # equal edges of several crops are ties
            assert sorted((r[3], r[4], r[1]) for r in got) == sorted((r[3], r[4], r[1]) for r in want)


def test_voxels_move_once(spark):
    """Voxels go straight to all blocks that see them: no task holds batches of whole blocks, and one exchange serves a rim wider than a block."""
    from voxspark.operators.neighbors import shift

    a = np.arange(1, 6 * 9 * 10 + 1).reshape(6, 9, 10)
    out = shift(volume(spark, a), (1, -5, 7), "label", block=(2, 4, 3))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == plan.count("MapInPandas") == 1
    moved = {(r.z, r.y, r.x): r.label for r in out.collect()}
    assert moved == {(z, y, x): a[min(z + 1, 5), max(y - 5, 0), min(x + 7, 9)] for z, y, x in np.ndindex(a.shape)}
