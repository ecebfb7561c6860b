"""SimHash near-duplicates by a self-join of binary tries.

A text's fingerprint takes one bit from each of the 64 bits of the XXH64 of its word
shingles: 1 if set in over half of them.  Different fingerprints with at most two
differing bits are found by walking pairs of trie nodes together: a pair carries the
number of bits in which its paths differ and is dropped when that exceeds the budget.

Three tries hold the fingerprints, each with another third of the bits first.  Two
differing bits leave one third untouched, so every pair is found in some trie with no
budget in its first third and the whole budget below: the descent begins with the root
paired with itself, goes on to equal children until the first third ends, and to pairs of
unlike children from there.

Subtrees are dealt to tasks by their first bits: as many as keep about ``subtree``
fingerprints together, or the whole first third where that would be too many.  A node at
the end of the first third with more than ``hot_node`` fingerprints is dealt out as the pairs
of its descendants six levels down whose paths differ in at most two bits.

Equal fingerprints are joined first, so a group of copies is one fingerprint whatever
its size, and what a task finds is passed on as stars around local roots.

Results for odd inputs: a null or empty text, or one of spaces, has fingerprint zero
and links like any other; a text of fewer words than a shingle is one shingle; a text of
any length is taken whole; rows with a null id take part, and a component's id is the
smallest id that is not null; an empty table gives no rows; columns other than doc_id and
the text are dropped, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .bytehash import as_bytes
from ..operators.components import connected, local_roots
from ..scratch import Scratch

U = np.uint64
PREFIX = (22, 21, 21)  # bits of each third
BUDGET = 2
FINE = 6
NEAR = np.array([[i, j] for i in range(1 << FINE) for j in range(i, 1 << FINE) if (i ^ j).bit_count() <= BUDGET])


@dataclass(frozen=True)
class SimhashParams:
    words: int = 3
    subtree: int = 20_000
    hot_node: int = 50_000


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64-bit fingerprint of a text in UTF-8."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - words + 1]
    ends, digest = ends[words - 1 :], xxhash.xxh64_intdigest
    set_ = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), 1 << 16):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : k + (1 << 16)].tolist(), ends[k : k + (1 << 16)].tolist())], dtype=">u8")
        set_ += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_ * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3):
    """docs with the column fp (the fingerprint as a signed long) in place of the text."""

    @F.pandas_udf(T.LongType())
    def of(column: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(as_bytes(t), words) for t in column], dtype=U).view(np.int64))

    return docs.withColumn("fp", of(text)).drop(text)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.astype(U))


def trie_pairs(values: np.ndarray, a_from, a_to, b_from, b_to, depth: int, differ, alike: int = 0, visits: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs of sorted distinct values within the budget, from the given pairs of nodes.

    A node is a range of values that share their first bits; all start at one depth.  A
    pair of equal ranges is a node with itself.  Down to the depth ``alike`` paths must not
    differ.  A pair of nodes with one value each is a pair of leaves: their remaining paths
    are compared at once.  visits counts the pairs of inner nodes and of leaves.
    """
    found_a, found_b = [], []
    nodes = np.array([a_from, a_to, b_from, b_to, differ], dtype=np.int64)
    for bit in range(63 - depth, -2, -1):
        size_a, size_b = nodes[1] - nodes[0], nodes[3] - nodes[2]
        self_ = nodes[0] == nodes[2]
        leaf = (size_a == 1) & (size_b == 1)
        i, j = nodes[0, leaf & ~self_], nodes[2, leaf & ~self_]
        near = _popcount(values[i] ^ values[j]) <= BUDGET
        found_a.append(i[near])
        found_b.append(j[near])
        nodes = nodes[:, ~leaf]
        if visits is not None:
            visits["leaves"] = visits.get("leaves", 0) + len(i)
            visits["inner"] = visits.get("inner", 0) + nodes.shape[1]
        if not nodes.size or bit < 0:
            break
        # the first value of a node with this bit set: below the node all higher bits are equal
        middle = [np.searchsorted(values, ((values[nodes[k]] >> U(bit)) | U(1)) << U(bit)) for k in (0, 2)]
        mid_a, mid_b = (np.clip(m, nodes[k], nodes[k + 1]) for m, k in zip(middle, (0, 2)))
        self_ = nodes[0] == nodes[2]
        d = nodes[4]
        every = np.ones(len(d), bool)
        split = [(nodes[0], mid_a, nodes[2], mid_b, d, every), (mid_a, nodes[1], mid_b, nodes[3], d, every)]
        if 63 - bit >= alike:
            split += [(nodes[0], mid_a, mid_b, nodes[3], d + 1, every), (mid_a, nodes[1], nodes[2], mid_b, d + 1, ~self_)]
        nodes = np.concatenate([np.array(s[:5])[:, s[5]] for s in split], axis=1)
        nodes = nodes[:, (nodes[4] <= BUDGET) & (nodes[1] > nodes[0]) & (nodes[3] > nodes[2])]
    return np.concatenate(found_a), np.concatenate(found_b)


def _join(frames, depths=PREFIX):
    """Stars over the near pairs of sorted subtree rows; a subtree may spread over several frames."""
    held: list[pd.DataFrame] = []
    last = None

    def walked():
        pdf = pd.concat(held, ignore_index=True)
        held.clear()
        return _walk(pdf, depths)

    for pdf in frames:
        group = pdf[GROUP].to_numpy()
        cut = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
        for start, end in zip([0, *cut.tolist()], [*cut.tolist(), len(pdf)]):
            if held and last != tuple(group[start]):
                yield walked()
            if 0 < start and end < len(pdf) and end - start == 1:
                continue  # one value has no pairs
            held.append(pdf.iloc[start:end])
            last = tuple(group[start])
    if held:
        yield walked()


def _walk(pdf: pd.DataFrame, depths) -> pd.DataFrame:
    """The descent in one subtree, or in one pair of a hot node's descendants."""
    trie, bits, _, pair = (int(pdf[c].iloc[0]) for c in GROUP)
    depth = depths[trie]
    values, fp = pdf["rotated"].to_numpy().view(U), pdf["fp"].to_numpy()
    if pair < 0:
        i, j = trie_pairs(values, [0], [len(values)], [0], [len(values)], bits, [0], depth)
    else:
        a, b = NEAR[pair]
        cut = int(np.searchsorted((values >> U(64 - depth - FINE)) & U((1 << FINE) - 1), b)) if a != b else 0
        ranges = ([0], [cut], [cut], [len(values)]) if a != b else ([0], [len(values)], [0], [len(values)])
        i, j = trie_pairs(values, *ranges, depth + FINE, [int(a ^ b).bit_count()]) if a == b or 0 < cut < len(values) else (np.empty(0, np.int64),) * 2
    return pd.DataFrame(dict(zip(("a", "b"), local_roots(fp[i], fp[j]))))


#: A unit of work: which trie, how many first bits its values share, these bits, and which pair of a hot node's descendants (or -1).
GROUP = ["trie", "bits", "part", "pair"]


def near_links(distinct: DataFrame, params: SimhashParams = SimhashParams()) -> DataFrame:
    """Links (a, b) that connect all fingerprints of distinct(fp) within the budget."""
    rotations = (0, PREFIX[0], PREFIX[0] + PREFIX[1])

    def rotated(r: int):
        fp = F.col("fp")
        return fp if r == 0 else F.shiftleft(fp, r).bitwiseOR(F.shiftrightunsigned(fp, 64 - r))

    shallow = min(min(PREFIX), max(0, math.ceil(math.log2(max(1, distinct.count()) / params.subtree))))
    tries = F.array(*(F.struct(F.lit(t).alias("trie"), F.shiftrightunsigned(rotated(r), 64 - PREFIX[t]).alias("node"), rotated(r).alias("rotated")) for t, r in enumerate(rotations)))
    rows = distinct.select("fp", F.explode(tries).alias("t")).select("fp", "t.*")
    third = F.element_at(F.array(*map(F.lit, PREFIX)), F.col("trie") + 1)
    top = F.expr(f"shiftrightunsigned(node, element_at(array({','.join(map(str, PREFIX))}), trie + 1) - {shallow})")
    rows = rows.withColumn("top", top)
    full = rows.groupBy("trie", "top").count().where(F.col("count") > 4 * params.subtree).select("trie", "top", F.lit(True).alias("deep"))
    hot = rows.groupBy("trie", "node").count().where(F.col("count") > params.hot_node).select("trie", "node", F.lit(True).alias("hot"))
    near = [[int(k) for k in np.flatnonzero((NEAR == i).any(axis=1))] for i in range(1 << FINE)]
    pairs = F.array(*(F.array(*map(F.lit, n)) for n in near))
    sub = F.expr(f"int(shiftrightunsigned(shiftleft(rotated, element_at(array({','.join(map(str, PREFIX))}), trie + 1)), {64 - FINE}))")
    dealt = rows.join(full, ["trie", "top"], "left").join(hot, ["trie", "node"], "left")
    dealt = dealt.withColumn("pair", F.explode(F.when(F.col("hot"), F.element_at(pairs, sub + 1)).otherwise(F.array(F.lit(-1)))))
    whole = F.col("hot").isNull() & F.col("deep").isNull()
    dealt = dealt.withColumn("bits", F.when(whole, shallow).otherwise(third)).withColumn("part", F.when(whole, F.col("top")).otherwise(F.col("node")))
    dealt = dealt.select(*GROUP, "fp", "rotated", F.col("rotated").bitwiseXOR(F.lit(-(1 << 63))).alias("rank"))
    return dealt.repartition(*GROUP).sortWithinPartitions(*GROUP, "rank").select(*GROUP, "fp", "rotated").mapInPandas(_join, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", params: SimhashParams = SimhashParams(), scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of docs(doc_id, text)."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs.select("doc_id", text), text, params.words), "fingerprints")
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    of = connected(near_links(distinct.select("fp"), params), scratch).select(F.col("node").alias("fp"), F.col("component"))
    groups = distinct.join(of, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = scratch.keep(groups.select("fp", "component").join(ids, "component").select("fp", "component_id"), "groups")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")
