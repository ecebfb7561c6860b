"""Graph agglomeration: components, Mutex Watershed, relabelling, filters and growth."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..scratch import Scratch
from .blocks import Blocks, Region, halo_apply, voxel_schema
from .components import connected, local_roots
from .lines import nearest, nearest_labels
from .neighbors import neighbours
from .prefix import consecutive


def resolve_roots(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of every node of edges(a, b): the smallest node that it is joined to."""
    scratch = scratch or Scratch(edges.sparkSession, "roots")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).where("node IS NOT NULL").distinct()
    found = connected(edges, scratch)
    return nodes.join(found.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("root"))


def label_components(df: DataFrame | Blocks, label: str = "label", connectivity: int = 1, min_voxels: int = 0, by: Sequence[str] = ("volume",), block: Sequence[int] = (32, 128, 128), steps: Sequence[Sequence[int]] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(by, z, y, x, component): connected voxels of one label; background 0.

    Ids go from 1 by each component's first voxel; components under min_voxels
    become 0 and leave gaps.  Blocks are labelled on their own; only voxels at block
    faces make links between blocks.
    """
    scratch = scratch or Scratch(df.sparkSession, "components")
    steps = [s for s in (steps or neighbours(connectivity)) if tuple(s) > (0, 0, 0)]  # one of each two directions

    def local(r: Region) -> pd.DataFrame:
        ids, values = r.ids(), np.where(r.present, r.arrays[label], 0)
        core_id, core = ids[r.core], values[r.core]
        inside = np.zeros(ids.shape, dtype=bool)
        inside[r.core] = True
        a, b, far_a, far_b = [], [], [], []
        for s in steps:
            here = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(s, ids.shape))
            there = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(s, ids.shape))
            same = (values[here] == values[there]) & (values[here] != 0)
            both = same & inside[here] & inside[there]
            a.append(ids[here][both])
            b.append(ids[there][both])
            one = same & (inside[here] != inside[there])
            far_a.append(ids[here][one])
            far_b.append(ids[there][one])
        node, root = local_roots(np.concatenate(a), np.concatenate(b))
        flat = core_id.ravel()
        own = flat.copy()
        own[np.searchsorted(flat, node)] = root  # flat ids rise within a block
        out = r.rows(by, node=core_id, root=np.where(core != 0, own.reshape(core.shape), -1))
        links = pd.DataFrame({"node": np.concatenate(far_a), "root": np.concatenate(far_b)})
        for c, v in zip(by, r.keys):
            links[c] = v
        return pd.concat([out.assign(link=False), links.assign(link=True, z=0, y=0, x=0)])[schema.names]

    schema = voxel_schema(df, by, node=T.LongType(), root=T.LongType(), link=T.BooleanType())
    parts = scratch.keep(halo_apply(df, [label], (1, 1, 1), local, schema, by, block, numbered=scratch), "local")
    voxels = parts.where("NOT link")
    cross = parts.where("link").select("node", F.col("root").alias("other"))
    at = voxels.where("root >= 0").select("node", "root")
    links = cross.join(at, "node").select("other", F.col("root").alias("a")).join(at.select(F.col("node").alias("other"), F.col("root").alias("b")), "other").select("a", "b")
    merged = connected(links, scratch)
    sizes = at.groupBy("root").agg(F.count("*").alias("n")).join(merged.withColumnRenamed("node", "root"), "root", "left").withColumn("final", F.coalesce("component", "root"))
    ranks = consecutive(sizes.select("final").distinct(), "final", scratch)
    total = sizes.groupBy("final").agg(F.sum("n").alias("total")).join(ranks, "final")
    lut = sizes.join(total, "final").select("root", F.when(F.col("total") >= min_voxels, F.col("rank")).otherwise(0).alias("component"))
    # background, which may be most of a volume, keeps out of the join on roots
    inside = voxels.where("root >= 0").join(lut, "root").select(*by, "z", "y", "x", "component")
    return inside.unionByName(voxels.where("root < 0").select(*by, "z", "y", "x", F.lit(0).cast("long").alias("component")))


def label_binary(df: DataFrame, mask: str, structure: Sequence[Sequence[int]] | None = None, by: Sequence[str] = ("volume",)) -> DataFrame:
    """Components of a mask under a structuring element given as steps; the number of components is the largest id."""
    return label_components(df.withColumn("_m", F.col(mask).cast("long")), "_m", steps=structure, by=by)


def relabel_consecutive(df: DataFrame, label: str = "label", ignore: int = -1, scratch: Scratch | None = None) -> DataFrame:
    """Ids to 1..K in order of the old ids; `ignore` and 0 to 0."""
    scratch = scratch or Scratch(df.sparkSession, "relabel")
    ids = df.where((F.col(label) != ignore) & (F.col(label) != 0)).select(F.col(label).alias("_old")).distinct()
    lut = consecutive(ids, "_old", scratch)
    kept = F.coalesce((F.col(label) != ignore) & (F.col(label) != 0), F.lit(False))
    named = df.where(kept).join(lut, F.col(label) == F.col("_old")).withColumn(label, F.col("rank").cast("long")).select(df.columns)
    return named.unionByName(df.where(~kept).withColumn(label, F.lit(0).cast("long")).select(df.columns))


def size_filter(df: DataFrame, min_size: int, label: str = "label", by: Sequence[str] = ("volume",)) -> DataFrame:
    """Components of fewer voxels become 0; then ids are made consecutive, if any went."""
    n = df.where(F.col(label) > 0).groupBy(*by, label).agg(F.count("*").alias("_n"))
    scratch = Scratch(df.sparkSession, "size-filter")
    kept = n.where(F.col("_n") >= min_size).select(F.struct(*by, label).alias("_key"))
    ranks = scratch.keep(consecutive(kept, "_key", scratch).select("_key.*", "rank"), "ranks")
    first = ranks.groupBy(*by).agg((F.min("rank") - 1).alias("_before"))
    rank = ranks.join(first, list(by)).select(*by, label, (F.col("rank") - F.col("_before")).alias("_r"))
    gone = n.where(F.col("_n") < min_size).select(*by).distinct().withColumn("_gone", F.lit(True))
    inside = F.coalesce(F.col(label) > 0, F.lit(False))
    out = df.where(inside).join(rank, [*by, label], "left").join(gone, list(by), "left")
    out = out.withColumn(label, F.when(F.col("_gone"), F.coalesce("_r", F.lit(0))).otherwise(F.col(label)).cast("long")).select(df.columns)
    return out.unionByName(df.where(~inside).withColumn(label, F.col(label).cast("long")).select(df.columns))


def mutex_core(u: np.ndarray, v: np.ndarray, is_mutex: np.ndarray, n: int) -> np.ndarray:
    """Clusters of nodes 0..n-1 from edges in order of priority."""
    parent, bans = list(range(n)), [set() for _ in range(n)]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, push in zip(u.tolist(), v.tolist(), is_mutex.tolist()):
        a, b = root(a), root(b)
        if a == b:
            continue
        if push:
            bans[a].add(b)
            bans[b].add(a)
        elif b not in bans[a]:
            if len(bans[a]) < len(bans[b]):
                a, b = b, a
            parent[b] = a  # a keeps the longer list of bans
            for c in bans[b]:
                bans[c].discard(b)
                bans[c].add(a)
                bans[a].add(c)
            bans[b] = set()
    return np.array([root(i) for i in range(n)], dtype=np.int64)


def mutex_rounds(u: np.ndarray, v: np.ndarray, is_mutex: np.ndarray, n: int, buckets: int = 16) -> np.ndarray:
    """Clusters of nodes 0..n-1 from edges in order of priority, approximately: whole arrays at a time, without a loop over edges.

    The edges are cut into buckets of equal numbers.  A bucket first sets its bans between
    clusters; then, round by round, each cluster joins the lower one to which its first edge
    without a ban leads.  Clusters that join at once may break each other's bans, so more
    buckets come closer to the sequential order; with one edge a bucket the result is exact.
    """
    root, bans = np.arange(n, dtype=np.int64), np.empty(0, dtype=np.int64)
    for k in range(buckets):
        part = slice(len(u) * k // buckets, len(u) * (k + 1) // buckets)
        a, b, push = u[part], v[part], is_mutex[part]
        while len(a):
            a, b = root[a], root[b]
            apart = a != b
            a, b, push = np.minimum(a, b)[apart], np.maximum(a, b)[apart], push[apart]
            pair = a * n + b
            x, y = root[bans // n], root[bans % n]
            moved = (np.minimum(x, y) * n + np.maximum(x, y))[x != y]
            bans = np.unique(np.concatenate([moved, pair[push]]))
            open_ = np.flatnonzero(~push & ~np.isin(pair, bans))
            if not len(open_):
                break
            _, best = np.unique(b[open_], return_index=True)  # the first is the heaviest
            best = open_[best]
            to = np.arange(n, dtype=np.int64)
            to[b[best]] = a[best]
            while (further := to[to]).tobytes() != to.tobytes():  # joins lead to lower nodes, so that chains end
                to = further
            root = to[root]
            a, b, push = a[~push], b[~push], push[~push]  # bans that are set follow their clusters
    return root


def _clusters(u: np.ndarray, v: np.ndarray, w: np.ndarray, off: np.ndarray, is_mutex: np.ndarray, n: int, method: str, buckets: int, max_edges: int, max_push: int | None = None) -> np.ndarray:
    """Labels from 1, by first node, of nodes 0..n-1 from edges in any order: by falling weight, ties by (off, u), with the first max_push push edges."""
    order = np.lexsort((u, off, -w))
    if max_push is not None:
        push = is_mutex[order]
        order = order[~push | (np.cumsum(push) <= max_push)]
    if len(order) > max_edges:
        raise ValueError(f"a crop with {len(order)} edges; cut it into smaller ones")
    ends = u[order], v[order], is_mutex[order], n
    roots = mutex_rounds(*ends, buckets) if method == "bucketed" else mutex_core(*ends)
    first = np.full(n, n, dtype=np.int64)
    np.minimum.at(first, roots, np.arange(n))
    return np.unique(first[roots], return_inverse=True)[1].astype(np.int64) + 1


def _check_method(method: str, buckets: int) -> None:
    if method not in ("exact", "bucketed"):
        raise ValueError(f"unknown method {method}")
    if buckets < 1:
        raise ValueError("at least one bucket")


def mutex_watershed(edges: DataFrame, nodes: DataFrame, by: Sequence[str] = ("volume",), max_edges: int = 50_000_000, method: str = "exact", buckets: int = 16) -> DataFrame:
    """(by, node, label): Mutex Watershed of each group of edges(by, u, v, w, off, is_mutex) and nodes(by, node).

    Groups (crops) run in parallel; within one the edges are taken by falling weight, ties by
    (off, u), one by one (exact) or in a number of buckets (bucketed, see mutex_rounds).  A group
    must fit a task: more than max_edges raise.  Use stitched crops or
    mutex.agglomerate_volume for whole volumes.
    """
    _check_method(method, buckets)

    def solve(key: tuple, e: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        node = np.sort(n["node"].to_numpy())
        ends = np.searchsorted(node, e["u"]), np.searchsorted(node, e["v"])
        label = _clusters(*ends, *(e[c].to_numpy() for c in ("w", "off")), e["is_mutex"].to_numpy(dtype=bool), len(node), method, buckets, max_edges)
        return pd.DataFrame({**dict(zip(by, key)), "node": node, "label": label})

    schema = T.StructType([nodes.schema[c] for c in by] + [T.StructField("node", T.LongType()), T.StructField("label", T.LongType())])
    nodes = nodes.select(*(F.col(c).alias(c) for c in (*by, "node")))  # both sides may stem from one table
    return edges.groupBy(*by).cogroup(nodes.groupBy(*by)).applyInPandas(solve, schema)


def mutex_bucketed(edges: DataFrame, nodes: DataFrame, buckets: int = 16, scratch: Scratch | None = None) -> DataFrame:
    """(node, root): approximate Mutex Watershed over whole tables, in joins and aggregates.

    Edges are taken in groups of falling weight.  Each group first sets its bans between
    clusters; then, round by round, clusters join the lower one to which their best edge
    without a ban leads, ties by (off, u), until no such edge is left.  In a round no
    cluster both moves and takes others in, and of two that may not meet only the better moves,
    so bans hold.
    """
    scratch = scratch or Scratch(edges.sparkSession, "bucketed")
    order = F.least(F.lit(buckets - 1), F.floor((1 - F.col("w")) * buckets)).cast("int")
    edges = scratch.keep(edges.select("u", "v", "w", "off", "is_mutex", F.greatest(order, F.lit(0)).alias("k")), "edges")
    roots = scratch.keep(nodes.select("node", F.col("node").alias("root")), "roots")
    bans = None

    def between(e: DataFrame) -> DataFrame:
        at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        both = e.join(at("u"), "u").join(at("v"), "v").where("ru <> rv")
        return both.withColumns({"a": F.least("ru", "rv"), "b": F.greatest("ru", "rv")})

    for k in range(buckets):
        group = edges.where(F.col("k") == k)
        new = between(group.where("is_mutex")).select("a", "b")
        bans = scratch.keep((new if bans is None else bans.unionByName(new)).distinct(), "bans")
        while True:
            open_ = between(group.where("NOT is_mutex")).join(bans, ["a", "b"], "left_anti")
            rank = F.struct(F.col("w").alias("w"), (-F.col("off")).alias("off"), (-F.col("u")).alias("u"))
            best = scratch.keep(open_.groupBy("b").agg(F.max(F.struct(rank.alias("rank"), "a")).alias("m")).select("b", "m.*"), "best")
            heads = best.join(best.select(F.col("b").alias("a")), "a", "left_anti")  # no chains: a stays where it is
            side = lambda c, n: heads.select(F.col("b").alias(c), F.col("a").alias(f"to{n}"), F.col("rank").alias(f"r{n}"))  # noqa: B023, E731
            clash = bans.join(side("a", 1), "a").join(side("b", 2), "b").where("to1 = to2")  # two that may not meet: the better goes first
            late = clash.select(F.when(F.col("r1") > F.col("r2"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct()
            hooks = scratch.keep(heads.join(late, "b", "left_anti").select("a", "b"), "hooks")
            if hooks.isEmpty():
                break
            moved = scratch.keep(connected(hooks, scratch), "moved")
            to = lambda c: moved.select(F.col("node").alias(c), F.col("component").alias(f"m{c}"))  # noqa: B023, E731
            roots = scratch.keep(roots.join(to("root"), "root", "left").select("node", F.coalesce("mroot", "root").alias("root")), "roots")
            a, b = F.coalesce("ma", "a"), F.coalesce("mb", "b")
            bans = scratch.keep(bans.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "bans")
    return roots


def stitch(labels: DataFrame, min_share: float = 0.5, scratch: Scratch | None = None) -> DataFrame:
    """Join labels of overlapping crops(crop, node, label): two labels become one if they share at least min_share of the smaller one's voxels in the overlap.

    Approximate at seams by design; (node, label) with the label from the smallest crop.
    """
    scratch = scratch or Scratch(labels.sparkSession, "stitch")
    key = labels.withColumn("key", F.xxhash64("crop", "label"))
    many = key.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    shared = scratch.keep(key.join(many, "node", "left_semi"), "overlap")
    sizes = shared.groupBy("key").agg(F.count("*").alias("size"))
    pairs = shared.alias("a").join(shared.alias("b"), (F.col("a.node") == F.col("b.node")) & (F.col("a.crop") < F.col("b.crop"))).groupBy(F.col("a.key").alias("a"), F.col("b.key").alias("b")).agg(F.count("*").alias("both"))
    s = lambda c: sizes.select(F.col("key").alias(c), F.col("size").alias(f"size_{c}"))
    links = pairs.join(s("a"), "a").join(s("b"), "b").where(F.col("both") >= min_share * F.least("size_a", "size_b")).select("a", "b")
    merged = connected(links, scratch).withColumnRenamed("node", "key")
    first = key.groupBy("node").agg(F.min_by("key", "crop").alias("key"))
    named = first.join(merged, "key", "left").select("node", F.coalesce("component", "key").alias("_c"))
    order = consecutive(named.groupBy("_c").agg(F.min("node").alias("first")).select("first"), "first", scratch)
    lut = named.groupBy("_c").agg(F.min("node").alias("first")).join(order, "first").select("_c", F.col("rank").alias("label"))
    return named.join(lut, "_c").select("node", "label")


def agglomerate(df: DataFrame, offsets, n_pull: int, aff: str = "aff", mask: str | None = None, strides=(1, 4, 4), min_size: int = 0, max_push_edges: int | None = None, by: Sequence[str] = ("volume",), method: str = "exact", buckets: int = 16, max_edges: int = 50_000_000, carry: Sequence[str] = ()) -> DataFrame:
    """(by, z, y, x, carry, label) from affinities per voxel: edges, cap within each group, Mutex Watershed (exact or bucketed), size filter; outside the mask 0.

    Voxels move once, to their crop's task, which makes the edges (as build_edges does, between
    voxels that are there), so a crop must fit a task: more than max_edges edges raise.  The columns `carry` go along.
    """
    _check_method(method, buckets)
    weights = [f"_w{k}" for k in range(len(offsets))]
    inside = F.coalesce(F.col(mask).cast("boolean"), F.lit(False)) if mask else F.lit(True)
    voxels = df.select(*by, "z", "y", "x", inside.alias("_in"), *(F.element_at(aff, k + 1).cast("float").alias(w) for k, w in enumerate(weights)), *(F.col(c).alias(f"_c_{c}") for c in carry))

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.stack([pdf[a].to_numpy(dtype=np.int64) for a in "zyx"])
        size = at.max(axis=1) + 1
        rows = np.flatnonzero(pdf["_in"].to_numpy(dtype=bool))
        rows = rows[np.argsort(np.ravel_multi_index(at[:, rows], size), kind="stable")]
        at = at[:, rows]
        node = np.ravel_multi_index(at, size)
        u, v, w, off = [], [], [], []
        for k, (o, name) in enumerate(zip(offsets, weights)):
            to = at + np.array(o)[:, None]
            ok = ((to >= 0) & (to < size[:, None])).all(axis=0)
            if k >= n_pull:
                ok &= ((at - np.maximum(0, -np.array(o))[:, None]) % np.array(strides)[:, None] == 0).all(axis=0)
            ok = np.flatnonzero(ok)
            target = np.ravel_multi_index(to[:, ok], size)
            there = np.minimum(np.searchsorted(node, target), max(len(node) - 1, 0))
            found = node[there] == target
            ok, there = ok[found], there[found]
            weight = pdf[name].to_numpy(dtype=np.float32)[rows[ok]]
            u.append(ok)
            v.append(there)
            w.append((np.float32(1) - weight if k >= n_pull else weight).astype(np.float64))
            off.append(np.full(len(ok), k))
        u, v, w, off = map(np.concatenate, (u, v, w, off))
        label = _clusters(u, v, w, off, off >= n_pull, len(node), method, buckets, max_edges, max_push_edges)
        n = np.bincount(label)
        if min_size and (n[1:] < min_size).any():
            stays = n >= min_size
            stays[:1] = False
            label = np.where(stays, np.cumsum(stays), 0)[label]
        out = np.zeros(len(pdf), dtype=np.int64)
        out[rows] = label
        return pdf[[*by, "z", "y", "x", *(f"_c_{c}" for c in carry)]].assign(label=out)

    schema = T.StructType([*(voxels.schema[c] for c in (*by, "z", "y", "x")), *(voxels.schema[f"_c_{c}"] for c in carry), T.StructField("label", T.LongType())])
    return voxels.groupBy(*by).applyInPandas(solve, schema).withColumnsRenamed({f"_c_{c}": c for c in carry})


def grow_labels(df: DataFrame | Blocks, label: str = "label", max_distance: float = 3, sampling: Sequence[float] = (1.0, 1.0, 1.0), by: Sequence[str] = ("volume",), block: Sequence[int] = (32, 128, 128)) -> DataFrame:
    """Background voxels within max_distance take the nearest label; ties go to the first (z, y, x).

    With max_distance of 0 or less all background is filled (a volume without labels stays as it is).
    A limit needs blocks with a rim of that width only; without one, lines cross the whole volume.
    """
    if max_distance <= 0:
        return nearest(df, label, sampling, carry=True, by=by, block=block).select(*by, "z", "y", "x", F.col("carried").alias(label))

    def grow(r: Region) -> pd.DataFrame:
        squared, found = nearest_labels(np.where(r.present, r.arrays[label], 0), sampling)
        return r.rows(by, **{label: np.where(squared <= max_distance**2, found, 0)[r.core].astype(np.int64)})

    reach = [int(max_distance // s) for s in sampling]
    return halo_apply(df, [label], reach, grow, voxel_schema(df, by, **{label: T.LongType()}), by, block)
