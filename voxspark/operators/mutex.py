"""Exact Mutex Watershed of whole volumes, by contraction in rounds.

The sequential rule takes edges by falling weight: a push edge bans its two clusters from
joining, a pull edge joins them if they are not banned.  An edge that comes before all other
open edges of both its clusters can be settled at once, whatever is open
elsewhere, with the same outcome.  A round uses this twice over:

* clusters are dealt to cells of space (the first time as voxels, whose edges the cell's task makes); a cell's task takes its edges in order and settles
  those whose clusters both lie in the cell, until an edge that leaves the cell, or one to a
  cluster held up in this way, holds up its clusters too;
* what is left is contracted: of all edges between two clusters only the first one counts, and
  none once they are banned.  Cells change places and grow from round to round, as long as
  a cell's pairs stay under a bound.

Where cells may not grow any more, rounds of joins settle each edge that is the first one
of both its clusters.  Every round settles the first open edge of all, so the rounds end;
clusters, bans and pairs are tables, and no task holds more than a cell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import Scratch
from .prefix import consecutive

#: Pairs of clusters a < b: banned, or with the first open edge between them.
PAIRS = "a long, b long, banned boolean, w double, off int, u0 long, push boolean"
SETTLED = f"hook boolean, {PAIRS}"
Cells = Callable[[Column, int, bool], Column]


def range_cells(span: int) -> Cells:
    """Cells as ranges of ids: twice as long with each level, moved by half a cell every other time."""
    return lambda node, level, moved: F.floor((node + ((span << level) // 2 if moved else 0)) / (span << level)).cast("long")


def block_cells(shape: Sequence[int], block: Sequence[int]) -> Cells:
    """Cells as blocks of a volume whose ids are (z * h + y) * w + x."""
    _, h, w = shape

    def cell(node: Column, level: int, moved: bool) -> Column:
        out = F.lit(0).cast("long")
        for at, size, b in zip((F.floor(node / (h * w)), F.floor(node / w) % h, node % w), shape, block):
            b <<= level
            out = out * (size // b + 2) + F.floor((at + (b // 2 if moved else 0)) / b)
        return out.cast("long")

    return cell


def settle(a: np.ndarray, b: np.ndarray, inside_a: np.ndarray, inside_b: np.ndarray, banned: np.ndarray, order: np.ndarray, push: np.ndarray):
    """Settle the pairs of one cell as far as they don't depend on others.

    order: open pairs by falling priority.  Returns ids, their clusters' smallest ids, the
    open pairs left between clusters of the cell, and the bans between such clusters.
    """
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)].tolist(), at[len(a) :].tolist()
    held = np.ones(len(ids), dtype=bool)
    held[at[: len(a)][inside_a]] = held[at[len(a) :][inside_b]] = False
    outside = held.copy()
    held = held.tolist()
    parent, bans = list(range(len(ids))), [set() for _ in ids]
    for i in np.flatnonzero(banned).tolist():
        bans[ia[i]].add(ib[i])
        bans[ib[i]].add(ia[i])

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left = []
    for i in order.tolist():
        p, q = root(ia[i]), root(ib[i])
        if p == q or q in bans[p]:
            continue
        if held[p] or held[q]:
            held[p] = held[q] = True
            left.append(i)
        elif push[i]:
            bans[p].add(q)
            bans[q].add(p)
        else:
            if len(bans[p]) < len(bans[q]):
                p, q = q, p
            parent[q] = p
            for c in bans[q]:
                bans[c].discard(q)
                bans[c].add(p)
            bans[p] |= bans[q]
            bans[q] = set()
    roots = np.array([root(i) for i in range(len(ids))], dtype=np.int64)
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, roots, ids)
    pairs = [(p, q) for p in range(len(ids)) if not outside[p] for q in bans[p] if p < q and not outside[q]]
    return ids, low[roots], np.array(left, dtype=np.int64), low[np.array(pairs, dtype=np.int64).reshape(-1, 2)]


def _cell_task(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b, banned = pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["banned"].to_numpy(dtype=bool)
    in_a, in_b = pdf["in_a"].to_numpy(dtype=bool), pdf["in_b"].to_numpy(dtype=bool)
    open_ = np.flatnonzero(~banned)
    w, off, u0, push = (pdf[c].to_numpy()[open_] for c in ("w", "off", "u0", "push"))
    order = open_[np.lexsort((u0.astype(np.int64), off.astype(np.int64), -w.astype(np.float64)))]
    flags = np.zeros(len(pdf), dtype=bool)
    flags[open_] = push.astype(bool)
    ids, low, left, bans = settle(a, b, in_a, in_b, banned, order, flags)
    name = lambda v: low[np.searchsorted(ids, v)]
    moved = ids != low
    hooks = pd.DataFrame({"hook": True, "a": ids[moved], "b": low[moved]})
    left = left[in_a[left] & in_b[left]]
    p, q = name(a[left]), name(b[left])
    rest = pd.DataFrame({"hook": False, "a": np.minimum(p, q), "b": np.maximum(p, q), "banned": False} | {c: pdf[c].to_numpy()[left] for c in ("w", "off", "u0", "push")})
    rest = rest[(p != q)].drop_duplicates(["a", "b"])  # the first one of a pair stays: they are in order
    if len(bans):
        pairs = np.unique(np.sort(bans, axis=1), axis=0)
        no = pd.DataFrame({"hook": False, "a": pairs[:, 0], "b": pairs[:, 1], "banned": True})
        rest = rest.merge(no[["a", "b"]], how="left", indicator=True).query("_merge == 'left_only'").drop(columns="_merge")
    else:
        no = hooks.iloc[:0]
    out = pd.concat([hooks, rest, no], ignore_index=True).reindex(columns=["hook", "a", "b", "banned", "w", "off", "u0", "push"])
    return out.astype({"hook": bool, "a": "int64", "b": "int64", "banned": "boolean", "w": float, "off": "Int32", "u0": "Int64", "push": "boolean"})


def _contract(pairs: DataFrame, hooks: DataFrame) -> DataFrame:
    """pairs with clusters renamed by hooks(a: old, b: new), one row for each pair."""
    to = lambda c: hooks.select(F.col("a").alias(c), F.col("b").alias(f"_{c}"))
    named = pairs.join(to("a"), "a", "left").join(to("b"), "b", "left")
    p, q = F.coalesce("_a", "a"), F.coalesce("_b", "b")
    named = named.select(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), "banned", "w", "off", "u0", "push").where("a <> b")
    first = F.max(F.when(~F.col("banned"), F.struct("w", (-F.col("off")).alias("off"), (-F.col("u0")).alias("u0"), "push"))).alias("e")
    one = named.groupBy("a", "b").agg(F.max("banned").alias("banned"), first)
    keep = lambda c: F.when(~F.col("banned"), c)
    return one.select("a", "b", "banned", keep(F.col("e.w")).alias("w"), keep(-F.col("e.off")).alias("off"), keep(-F.col("e.u0")).alias("u0"), keep(F.col("e.push")).alias("push"))


def _volume_round(voxels: DataFrame, shape: Sequence[int], offsets: Sequence[Sequence[int]], n_pull: int, strides: Sequence[int], masked: bool, block: Sequence[int], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pairs, hooks) after the first round, straight from voxels(z, y, x, _w0, _w1 ...): cells get their voxels and those that share an edge with one, and make the edges (as build_edges does)."""
    sides = [1, -1] if masked else [1]  # with a mask an edge's far end must be known to be there

    def cell(at: Sequence[Column]) -> Column:
        out = F.lit(0).cast("long")
        for c, size, b in zip(at, shape, block):
            out = out * (size // b + 1) + F.floor(c / b)
        return F.when(sum((((c < 0) | (c >= n)).cast("int") for c, n in zip(at, shape)), F.lit(0)) == 0, out)

    places = [cell([F.col(a) + s * d for a, d in zip("zyx", o)]) for o in ((0, 0, 0), *offsets) for s in sides]
    dealt = voxels.withColumn("cell", F.explode(F.array_compact(F.array_distinct(F.array(*places)))))

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.stack([pdf[a].to_numpy(dtype=np.int64) for a in "zyx"])
        size, steps = np.array(shape)[:, None], np.array(block)[:, None]
        here = lambda p: np.ravel_multi_index(p // steps, [n // b + 1 for n, b in zip(shape, block)]) == key[0]
        node, own = np.ravel_multi_index(at, shape), here(at)
        known, parts = np.sort(node), []
        for k, o in enumerate(np.array(offsets)[:, :, None]):
            to = at + o
            ok = ((to >= 0) & (to < size)).all(axis=0)
            if k >= n_pull:
                ok &= ((at - np.maximum(0, -o)) % np.array(strides)[:, None] == 0).all(axis=0)
            ok = np.flatnonzero(ok)
            to = to[:, ok]
            v, there = np.ravel_multi_index(to, shape), here(to)
            take = own[ok] | there
            if masked:
                take &= known[np.minimum(np.searchsorted(known, v), len(known) - 1)] == v
            ok, v, there = ok[take], v[take], there[take]
            u, w = node[ok], pdf[f"_w{k}"].to_numpy(dtype=np.float32)[ok]
            w = (np.float32(1) - w if k >= n_pull else w).astype(np.float64)
            low = u < v
            parts.append(pd.DataFrame({"a": np.minimum(u, v), "b": np.maximum(u, v), "banned": False, "w": w, "off": k, "u0": u, "push": k >= n_pull, "in_a": np.where(low, own[ok], there), "in_b": np.where(low, there, own[ok])}))
        edges = pd.concat(parts, ignore_index=True)
        edges = edges[edges["a"] != edges["b"]].reset_index(drop=True)
        out = _cell_task(edges).assign(across=False)
        far = edges[(edges["u0"] == edges["a"]) & edges["in_a"] & ~edges["in_b"] | (edges["u0"] == edges["b"]) & edges["in_b"] & ~edges["in_a"]]  # each from the cell of its first end
        far = far.drop(columns=["in_a", "in_b"]).assign(hook=False, across=True)
        return pd.concat([out, far.astype({"banned": "boolean", "off": "Int32", "u0": "Int64", "push": "boolean"})], ignore_index=True)[[*out.columns]]

    done = scratch.keep(dealt.groupBy("cell").applyInPandas(first, f"{SETTLED}, across boolean"), "settled")
    hooks = scratch.keep(done.where("hook").select("a", "b"), "hooks")
    across = _contract(done.where("across").drop("hook", "across"), hooks)
    pairs = scratch.keep(done.where("NOT hook AND NOT across").drop("hook", "across").unionByName(across), "pairs")
    scratch.drop(done)
    return pairs, hooks


def _cell_round(pairs: DataFrame, cells: Cells, level: int, moved: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pairs, hooks) after all cells have settled what they can."""
    placed = pairs.withColumns({"ca": cells(F.col("a"), level, moved), "cb": cells(F.col("b"), level, moved)})
    dealt = placed.withColumn("cell", F.explode(F.array_distinct(F.array("ca", "cb"))))
    dealt = dealt.select("cell", *(c for c in ("a", "b", "banned", "w", "off", "u0", "push")), (F.col("ca") == F.col("cell")).alias("in_a"), (F.col("cb") == F.col("cell")).alias("in_b"))
    done = scratch.keep(dealt.groupBy("cell").applyInPandas(_cell_task, SETTLED), "settled")
    hooks = done.where("hook").select("a", "b")
    across = _contract(placed.where("ca <> cb").drop("ca", "cb"), hooks)
    out = scratch.keep(done.where("NOT hook").drop("hook").unionByName(across), "pairs")
    hooks = scratch.keep(hooks, "hooks")
    scratch.drop(done)
    return out, hooks


def _join_round(pairs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pairs, hooks) after each pair that is the first one of both its clusters has been settled."""
    rank = F.struct("w", (-F.col("off")).alias("off"), (-F.col("u0")).alias("u0"), "a", "b")
    open_ = pairs.where("NOT banned").withColumn("rank", rank)
    ends = open_.select(F.col("a").alias("x"), "rank", "push").unionByName(open_.select(F.col("b").alias("x"), "rank", "push"))
    top = ends.groupBy("x").agg(F.max(F.struct("rank", "push")).alias("t"))
    first = top.groupBy("t").agg(F.count("*").alias("n")).where("n = 2").select("t.rank.a", "t.rank.b", "t.push")
    first = scratch.keep(first, "first")
    hooks = scratch.keep(first.where("NOT push").select(F.col("b").alias("a"), F.col("a").alias("b")), "hooks")
    marked = pairs.join(first.where("push").select("a", "b", F.lit(True).alias("_ban")), ["a", "b"], "left")
    marked = marked.withColumn("banned", F.col("banned") | F.coalesce("_ban", F.lit(False))).drop("_ban")
    out = scratch.keep(_contract(marked, hooks), "pairs")
    scratch.drop(first)
    return out, hooks


def _follow(links: list[DataFrame], scratch: Scratch, large: int = 6) -> DataFrame | None:
    """(node, root) of all clusters that were renamed, from each round's hooks(a: old, b: new); a cluster is renamed once and never to one that is gone.

    The first rounds rename most: they are taken from the last to the first, so that each one's hooks meet only
    what comes after them.  All rounds after those are followed at once, by jumps that double.
    """
    found = None
    for hooks in links[large:]:
        pairs = hooks.select(F.col("a").alias("node"), F.col("b").alias("root"))
        found = pairs if found is None else found.unionByName(pairs)
    jumps = max(0, len(links) - large - 1).bit_length()
    for hooks in [None] * jumps + links[:large][::-1]:
        if found is None:
            found = hooks.select(F.col("a").alias("node"), F.col("b").alias("root"))
            continue
        rows = found if hooks is None else hooks.select(F.col("a").alias("node"), F.col("b").alias("root"))
        later = found.select(F.col("node").alias("root"), F.col("root").alias("_r"))
        named = rows.join(later.hint("merge"), "root", "left").select("node", F.coalesce("_r", "root").alias("root"))
        before, found = found, scratch.keep(named if hooks is None else named.unionByName(found), "found")
        scratch.drop(before)
    return found


def mutex_exact(edges: DataFrame, nodes: DataFrame, cells: Cells, max_pairs: int = 4_000_000, join_rounds: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """(node, label): the Mutex Watershed of edges(u, v, w, off, is_mutex) and nodes(node), exact; labels from 1 by smallest node.

    Edges are taken by falling weight, ties by (off, u).  cells(node, level, moved) places nodes;
    cells grow while none has more than max_pairs pairs, which is what a task must hold.
    """
    scratch = scratch or Scratch(edges.sparkSession, "mutex")
    pairs = edges.where("u <> v").select(
        F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.lit(False).alias("banned"), F.col("w").cast("double").alias("w"), F.col("off").cast("int").alias("off"),
        F.col("u").cast("long").alias("u0"), F.col("is_mutex").alias("push"),
    )
    return _rounds(scratch.keep(pairs, "pairs"), [], nodes, cells, False, max_pairs, join_rounds, scratch)


def _rounds(pairs: DataFrame, links: list[DataFrame], nodes: DataFrame, cells: Cells, moved: bool, max_pairs: int, join_rounds: int, scratch: Scratch) -> DataFrame:
    """(node, label) from pairs and the hooks so far: rounds until no pair is open; moved: whether cells begin in their second place."""
    level, left = 0, pairs.where("NOT banned").count()
    while left:
        before, old = left, pairs
        pairs, hooks = _cell_round(pairs, cells, level, moved, scratch)
        links.append(hooks)
        scratch.drop(old)
        left = pairs.where("NOT banned").count()
        if moved and left:  # both places of this size have been tried
            level += 1
            most = pairs.groupBy(cells(F.col("a"), level, False).alias("cell")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
            if most > max_pairs:
                level -= 1
                for _ in range(join_rounds if left < before / 2 else 1 << 30):
                    old = pairs
                    pairs, hooks = _join_round(pairs, scratch)
                    links.append(hooks)
                    scratch.drop(old)
                    now = pairs.where("NOT banned").count()
                    if not now or now < left / 2:  # contracted: cells may help again
                        left = now
                        break
                    left = now
        moved = not moved
    found = _follow(links, scratch)
    named = nodes.select("node")
    if found is not None:
        named = named.join(found.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    else:
        named = named.select("node", F.col("node").alias("root"))
    named = scratch.keep(named, "roots")
    ranks = consecutive(named.select("root").distinct(), "root", scratch)
    return scratch.finish(named.join(ranks, "root").select("node", F.col("rank").alias("label")))


def agglomerate_volume(df: DataFrame, offsets: Sequence[Sequence[int]], n_pull: int, aff: str = "aff", mask: str | None = None, strides: Sequence[int] = (1, 4, 4), block: Sequence[int] = (32, 128, 128), max_pairs: int = 4_000_000, scratch: Scratch | None = None) -> DataFrame:
    """(z, y, x, label) of one whole volume from affinities per voxel, as if by one sequential pass; outside the mask 0."""
    scratch = scratch or Scratch(df.sparkSession, "mutex")
    df = Scratch(df.sparkSession, "voxels").keep(df.select("z", "y", "x", aff, *([mask] if mask else [])))  # what gives the affinities runs once; the result needs them still
    shape = df.agg(*(F.max(a) + 1 for a in "zyx")).first()
    if shape[0] is None:
        return df.select("z", "y", "x", F.lit(0).cast("long").alias("label"))
    shape = [int(n) for n in shape]
    inside = df.where(F.col(mask)) if mask else df
    voxels = inside.select("z", "y", "x", *(F.element_at(aff, k + 1).cast("float").alias(f"_w{k}") for k in range(len(offsets))))
    pairs, hooks = _volume_round(voxels, shape, offsets, n_pull, strides, mask is not None, block, scratch)
    node = (F.col("z").cast("long") * shape[1] + F.col("y")) * shape[2] + F.col("x")
    labels = _rounds(pairs, [hooks], inside.select(node.alias("node")), block_cells(shape, block), True, max_pairs, 3, scratch)
    return df.withColumn("node", node).join(labels, "node", "left").select("z", "y", "x", F.coalesce("label", F.lit(0).cast("long")).alias("label"))
