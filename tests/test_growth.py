"""Steps whose work must not grow faster than their input."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxspark.operators import augment as A, catalog as C, graph as G, metrics as M, neighbors as N


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("mode", ["linear", "nearest"])
def test_resample_joins_nothing_but_sizes(spark, mode):
    v = spark.range(60).select(F.lit("V").alias("volume"), *((F.col("id") / k % n).cast("int").alias(a) for a, k, n in (("z", 20, 3), ("y", 5, 4), ("x", 1, 5))), F.col("id").cast("double").alias("val"))
    out = A.resample(v, "val", (1, 0.5, 2.3), mode)
    join = plan(out).split("Join")
    assert len(join) == 2 and "sequence" not in join[1]
    assert out.count() == 3 * 2 * 12


@pytest.mark.parametrize("mode", ["linear", "nearest"])
def test_resample_of_one_line(spark, mode):
    """Against numbers worked out one by one, for finer and coarser grids."""
    for n, m in [(7, 3), (3, 7), (5, 5), (6, 4), (1, 4), (9, 1), (10, 30), (49, 7)]:
        v = spark.range(n).select(F.lit("V").alias("volume"), F.lit(0).alias("z"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"), (F.col("id") * F.col("id")).cast("double").alias("val"))
        got = {r.x: r.val for r in A.resample(v, "val", (1, 1, 1), mode, (1, 1, m)).collect()}
        for i in range(m):
            at = max((i + 0.5) * (n / m) - 0.5, 0.0)
            low = min(int(at), n - 1)
            up, part = min(low + 1, n - 1), at - low
            want = min(int(i * (n / m)), n - 1) ** 2 if mode == "nearest" else low**2 * (1 - part) + up**2 * part
            assert got[i] == pytest.approx(want), (n, m, i)
        assert len(got) == m


def boxes(spark, n, seed):
    r = random.Random(seed)
    rows = [(f"b{i}", "V", *(r.randrange(-2, 12) for _ in range(3)), *(r.randrange(0, 6) for _ in range(3))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "name string, volume string, z int, y int, x int, sz int, sy int, sx int")


def test_crop_boxes_meet_lines(spark):
    v = spark.range(1000).select(F.lit("V").alias("volume"), *((F.col("id") / k % 10).cast("int").alias(a) for a, k in (("z", 100), ("y", 10), ("x", 1))), F.col("id").alias("val"))
    rows, df = boxes(spark, 60, 1)
    out = C.crop_boxes(v, df, 4)
    assert set(re.findall(r"cast\((\w+)#\d+ as double\) / 4\.0", plan(out))) == {"ox", "x"}  # cells along x alone
    want = {(n, z - bz, y - by, x - bx, z * 100 + y * 10 + x) for n, _, bz, by, bx, sz, sy, sx in rows for z in range(bz, bz + sz) for y in range(by, by + sy) for x in range(bx, bx + sx) if all(0 <= k < 10 for k in (z, y, x))}
    got = [(r.name, r.z, r.y, r.x, r.val) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("per_task", [3, 2000])
def test_overlaps_of_a_crowded_cell_are_dealt_out(spark, per_task):
    rows, _ = boxes(spark, 80, 2)
    rows = [(*r[:5], *(max(s, 1) for s in r[5:])) for r in rows] + [("huge", "V", -5, -5, -5, 500, 3, 40)]
    df = spark.createDataFrame(rows, "name string, volume string, z int, y int, x int, sz int, sy int, sx int")
    hit = lambda a, b: all(a[k] < b[k] + b[k + 3] and b[k] < a[k] + a[k + 3] for k in (2, 3, 4))
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and hit(a, b))
    out = C.split_overlaps(df, per_task=per_task)
    assert sorted(map(tuple, out.collect())) == want
    assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()


def clusterings(spark, n):
    pair = [(F.xxhash64("id", F.lit(k)) % m + 1).alias(c) for k, c, m in ((1, "true", 5), (2, "pred", 7))]
    return spark.range(n).select((F.col("id") % 3).alias("s"), *pair)


def test_ami_deals_pairs_of_sizes_to_tasks(spark):
    out = M.ami(clusterings(spark, 300), ["s"])
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_expected_information_in_parts():
    r = random.Random(3)
    rows = [(a, b, n) for n in (30, 200) for a, b in ((r.randrange(1, n), r.randrange(1, n)) for _ in range(20))]
    a, b, n = (np.array(v) for v in zip(*rows))
    first, last = np.maximum(1, a + b - n), np.minimum(a, b)
    f = lambda k: math.lgamma(k + 1)
    p = lambda a, b, n, k: math.exp(f(a) + f(b) + f(n - a) + f(n - b) - f(n) - f(k) - f(a - k) - f(b - k) - f(n - a - b + k))
    want = [sum(k / n * math.log(n * k / (a * b)) * p(a, b, n, k) for k in range(i, j + 1)) for a, b, n, i, j in zip(a.tolist(), b.tolist(), n.tolist(), first.tolist(), last.tolist())]
    for most in (1, 50, 1 << 18):
        assert M.expected_information(a, b, n, first, last, most) == pytest.approx(want, abs=1e-9)


def test_report_reads_its_labels_once(spark):
    seen = spark.sparkContext.accumulator(0)
    df = clusterings(spark, 300)

    def look(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    assert M.instance_report(df.mapInPandas(look, df.schema), ["s"]).count() == 18
    assert seen.value == 300


def test_roots_are_joined_without_a_broadcast(spark):
    links = spark.range(50).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    out = G.resolve_roots(links)
    assert {r.node: r.root for r in out.collect()} == {i: i % 7 for i in range(50)}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_edges_do_not_meet_at_their_volume(spark):
    v = spark.range(60).select(F.lit("V").alias("volume"), *((F.col("id") / k % n).cast("int").alias(a) for a, k, n in (("z", 20, 3), ("y", 5, 4), ("x", 1, 5))), F.array(F.lit(0.5)).alias("aff"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for shapes in (None, spark.createDataFrame([("V", 3, 4, 5)], "volume string, d int, h int, w int")):
            out = N.build_edges(v, [(0, 0, -1)], 1, shapes=shapes)
            assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
            assert out.count() == 48
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_crops_move_once(spark):
    """No joins and one shuffle; an edge to an absent voxel joins nothing."""
    rows = [(s, 0, 0, x, [0.9, 0.8], s * 10 + x) for s in (1, 2) for x in (0, 2, 3)]
    df = spark.createDataFrame(rows, "sample_id int, z int, y int, x int, aff array<double>, was int")
    out = G.agglomerate(df, [(0, 0, 1), (0, 0, -2)], 1, strides=(1, 1, 1), by=["sample_id"], carry=["was"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    got = sorted((r.sample_id, r.x, r.was, r.label) for r in out.collect())
    assert got == [(s, x, s * 10 + x, label) for s in (1, 2) for x, label in ((0, 1), (2, 2), (3, 2))]


def _records_sent(plan) -> int:
    """Rows that the exchanges of an executed plan have written."""
    kind, sent = plan.nodeName(), 0
    if kind == "Exchange" and plan.metrics().contains("shuffleRecordsWritten"):
        sent += plan.metrics().apply("shuffleRecordsWritten").value()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in kind else []
    children = plan.children()
    return sent + sum(map(_records_sent, [*inner, *(children.apply(i) for i in range(children.length()))]))


def test_boxes_of_a_crowded_cell_move_once(spark):
    n = 4_500
    i = F.col("id").cast("int")
    boxes = spark.range(n).select(F.format_string("b%d", i).alias("name"), (i % 10 * 2).alias("z"), F.floor(i / 10 % 10 * 2).cast("int").alias("y"), F.floor(i / 100).cast("int").alias("x"), *(F.lit(1).alias(s) for s in ("sz", "sy", "sx")))
    out = C.split_overlaps(boxes, cell=100)
    assert len(out.collect()) == out.distinct().count()
    assert _records_sent(out._jdf.queryExecution().executedPlan()) < 2.2 * n
