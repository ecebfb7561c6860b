"""The exact Mutex Watershed of whole volumes against the sequential rule."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxspark.operators.graph import mutex_core
from voxspark.operators.mutex import agglomerate_volume, block_cells, mutex_exact, range_cells
from voxspark.scratch import Scratch


def sequential(n, edges):
    e = sorted(edges, key=lambda r: (-r[2], r[3], r[0]))
    roots = mutex_core(*(np.array([r[k] for r in e], dtype=np.int64) for k in (0, 1)), np.array([r[4] for r in e], dtype=bool), n)
    low = np.full(n, n)
    np.minimum.at(low, roots, np.arange(n))
    return np.unique(low[roots], return_inverse=True)[1] + 1


def graph(seed, n):
    """Random edges, near in number and far; weights with and without ties."""
    rng, out = random.Random(seed), {}
    for k in range(6 * n):
        u = rng.randrange(n)
        v = min(n - 1, max(0, u + rng.choice([1, 1, 1, -1, 3, -7, rng.randrange(-n, n)])))
        w = rng.choice([0.1, 0.3, 0.5, 0.7]) if seed % 2 else rng.random()
        if u != v:
            out[u, k % 5] = (u, v, w, k % 5, rng.random() < 0.35)  # (off, u) once
    return list(out.values())


@pytest.mark.parametrize("seed,n,span,bound", [(1, 90, 10, 10**6), (2, 150, 40, 10**6), (3, 70, 8, 40), (4, 50, 1, 1), (5, 60, 1000, 10**6)])
def test_graphs(spark, seed, n, span, bound):
    """Cells that grow to the whole, and cells that may not grow, so that joins do the rest."""
    edges = graph(seed, n)
    got = mutex_exact(spark.createDataFrame(edges, "u long, v long, w double, off int, is_mutex boolean"), spark.range(n).withColumnRenamed("id", "node"), range_cells(span), bound).collect()
    assert [r.label for r in sorted(got, key=lambda r: r.node)] == sequential(n, edges).tolist()


def test_no_edges(spark):
    none = spark.createDataFrame([], "u long, v long, w double, off int, is_mutex boolean")
    got = mutex_exact(none, spark.range(3).withColumnRenamed("id", "node"), range_cells(2)).collect()
    assert sorted((r.node, r.label) for r in got) == [(0, 1), (1, 2), (2, 3)]


OFFSETS, N_PULL = [(-1, 0, 0), (0, -1, 0), (0, 0, -1), (0, -2, 0), (0, 0, -3)], 3


@pytest.mark.parametrize("masked", [False, True])
def test_volume(spark, masked):
    shape, rng = (4, 9, 10), np.random.default_rng(8)
    truth = (np.indices(shape)[1] // 3) * 4 + np.indices(shape)[2] // 3 + np.indices(shape)[0] // 2 * 20
    aff, mask = {}, rng.random(shape) < 0.9
    for i in np.ndindex(shape):
        j = [tuple(np.clip(np.add(i, o), 0, np.array(shape) - 1)) for o in OFFSETS]
        aff[i] = [float(np.clip((0.8 if truth[i] == truth[k] else 0.2) + rng.normal(0, 0.25), 0, 1)) for k in j]
    rows = [(*map(int, i), a, bool(mask[i])) for i, a in aff.items()]
    df = spark.createDataFrame(rows, "z int, y int, x int, aff array<double>, m boolean")
    got = agglomerate_volume(df, OFFSETS, N_PULL, mask="m" if masked else None, strides=(1, 2, 2), block=(2, 3, 4))
    flat, edges = (lambda i: (int(i[0]) * shape[1] + int(i[1])) * shape[2] + int(i[2])), []
    for i, a in aff.items():
        for k, o in enumerate(OFFSETS):
            j = tuple(np.add(i, o))
            on_grid = k < N_PULL or all((p - max(0, -d)) % s == 0 for p, d, s in zip(i, o, (1, 2, 2)))
            if all(0 <= p < n for p, n in zip(j, shape)) and on_grid and (not masked or (mask[i] and mask[j])):
                w = np.float32(a[k])
                edges.append((flat(i), flat(j), float(w if k < N_PULL else np.float32(1) - w), k, k >= N_PULL))
    want = sequential(int(np.prod(shape)), edges).reshape(shape)
    have = np.zeros(shape, dtype=int)
    for r in got.collect():
        have[r.z, r.y, r.x] = r.label
    inside = mask if masked else np.ones(shape, dtype=bool)
    assert (have[~inside] == 0).all() and len(set(want[inside].tolist())) > 5
    assert len(set(zip(have[inside].tolist(), want[inside].tolist()))) == len(set(have[inside].tolist())) == len(set(want[inside].tolist()))


def test_block_cells(spark):
    cell = block_cells((4, 6, 8), (2, 2, 4))
    df = spark.range(4 * 6 * 8).select("id", *(cell(F.col("id"), level, moved).alias(f"c{level}{int(moved)}") for level in (0, 1, 5) for moved in (False, True)))
    rows = [r.asDict() for r in df.collect()]
    z, y, x = (np.array([r["id"] for r in rows]) // 48, np.array([r["id"] for r in rows]) // 8 % 6, np.array([r["id"] for r in rows]) % 8)
    for name, want in (("c00", list(zip(z // 2, y // 2, x // 4))), ("c01", list(zip((z + 1) // 2, (y + 1) // 2, (x + 2) // 4))), ("c50", [0] * len(rows))):
        have = [r[name] for r in rows]
        assert len(set(zip(have, want))) == len(set(have)) == len(set(want))


def test_scratch_is_cleared(spark):
    scratch = Scratch(spark, "mutex-test")
    edges = spark.createDataFrame(graph(2, 50), "u long, v long, w double, off int, is_mutex boolean")
    mutex_exact(edges, spark.range(50).withColumnRenamed("id", "node"), range_cells(8), scratch=scratch).collect()
    assert len(scratch._kept) == 1


def test_whole_volume_of_the_query(spark, sf_dir):
    """The query's volume in one piece, edge by edge."""
    from voxspark.operators.neighbors import build_edges
    from voxspark.plans import graph_queries as Q

    e = build_edges(Q.head(spark, sf_dir), Q.OFFSETS, Q.N_PULL, "prob", (1, 2, 2)).toPandas()
    got = Q.mutex_watershed_volume(spark, sf_dir).toPandas().sort_values(["z", "y", "x"])
    want = sequential(len(got), list(e[["u", "v", "w", "off", "is_mutex"]].itertuples(index=False, name=None)))
    assert got["label"].tolist() == want.tolist() and want.max() > 20


@pytest.mark.parametrize("rounds", [1, 4, 6, 7, 11])
def test_renamed_clusters_are_followed(spark, rounds):
    """Chains through all rounds, without rounds of components."""
    from voxspark.operators.mutex import _follow

    rng, alive, root, links = random.Random(rounds), list(range(40)), {}, []
    for _ in range(rounds):
        gone = rng.sample(alive[1:], 3)
        alive = [i for i in alive if i not in gone]
        links.append([(i, rng.choice(alive)) for i in gone])
    for i, to in (h for hooks in reversed(links) for h in hooks):
        root[i] = root.get(to, to)
    got = _follow([spark.createDataFrame(h, "a long, b long") for h in links], Scratch(spark, "follow"))
    assert {(r.node, r.root) for r in got.collect()} == set(root.items())
