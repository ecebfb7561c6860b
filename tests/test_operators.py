"""Small cases with known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxspark.operators import augment as A, blend as B, catalog as C, losses as L, metrics as M, normalize as N, tiling as T, views as W
from voxspark.scratch import Scratch
from voxspark.sources import arrays


def one(df):
    return df.first().asDict()


def pairs(spark, rows):
    return spark.createDataFrame(rows, "true long, pred long")


def test_perfect_and_empty(spark):
    same = pairs(spark, [(1, 1), (1, 1), (2, 2), (2, 2)])
    none = pairs(spark, [(0, 0)] * 4)
    assert one(M.ari(same))["ari"] == 1 and one(M.ami(same))["ami"] == 1 and one(M.ted(same))["ted"] == 0
    assert one(M.voi(same)) == {"voi_split": 0, "voi_merge": 0, "voi": 0}
    assert one(M.ari(none))["ari"] == 0 and one(M.ami(none))["ami"] == 0 and one(M.voi(none))["voi"] == 0
    assert M.prepare_labels(pairs(spark, [(1, 1), (1, 2), (0, 0), (2, 1)])).count() == 3


def test_known_values(spark):
    df = pairs(spark, [(1, 1)] * 2 + [(1, 2)] * 2 + [(2, 2)] * 4)
    v = one(M.voi(df))
    assert v["voi_split"] == pytest.approx(0.5) and v["voi_merge"] == pytest.approx(6 / 8 * (math.log2(6) - (4 * math.log2(4) + 2 * math.log2(2)) / 6))
    assert one(M.ted(df))["ted"] == 2
    p = pairs(spark, [(1, 1), (1, 0), (0, 0), (0, 0)])
    assert one(M.dice(p))["dice"] == pytest.approx((2 / 3 + 4 / 5) / 2) and one(M.iou(p))["iou"] == 0.5 and one(M.accuracy(p))["accuracy"] == 0.75
    assert one(M.iou(pairs(spark, [(0, 1)])))["iou"] == 0 and one(M.dice(pairs(spark, [(0, 0)])))["dice"] == 1


def test_accumulate_drops_weightless(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 3.0), ("b", 9.0, 0.0)], "k string, v double, w double")
    assert [(r.k, r["mean"]) for r in M.metric_accumulate(df, "k", "v", "w").collect()] == [("a", 2.5)]


@pytest.mark.parametrize("shape,patch,overlap,count", [((8, 8, 8), 4, 0, 8), ((16, 16, 16), 8, 0.5, 27), ((10, 8, 8), 4, 0, 12), ((3, 3, 3), 4, 0, 1)])
def test_tiling(spark, shape, patch, overlap, count):
    v = spark.createDataFrame([("v", *shape)], "volume string, d int, h int, w int")
    rows = T.tile_patches(v, (patch,) * 3, overlap).orderBy("patch_idx").collect()
    assert len(rows) == count and [(r.z, r.y, r.x) for r in rows] == sorted((r.z, r.y, r.x) for r in rows)
    seen = np.zeros(shape, bool)
    for r in rows:
        assert all(r[a] + r[f"s{a}"] <= n for a, n in zip("zyx", shape))
        seen[r.z : r.z + r.sz, r.y : r.y + r.sy, r.x : r.x + r.sx] = True
    assert seen.all()


def grid(spark, shape=(4, 4, 4), value="0.25"):
    d, h, w = shape
    return spark.sql(f"SELECT 'v' AS volume, z, y, x, CAST({value} AS DOUBLE) AS val FROM (SELECT explode(sequence(0, {d - 1})) AS z), (SELECT explode(sequence(0, {h - 1})) AS y), (SELECT explode(sequence(0, {w - 1})) AS x)")


def test_constant_is_kept_by_blending(spark):
    v = grid(spark, (8, 8, 8))
    sizes = spark.createDataFrame([("v", 8, 8, 8)], "volume string, d int, h int, w int")
    windows = B.window_grid(sizes, (4, 4, 4), (2, 2, 2)).withColumns({"sz": F.lit(4), "sy": F.lit(4), "sx": F.lit(4), "oz": F.col("z"), "oy": F.col("y"), "ox": F.col("x")}).withColumnsRenamed({"oz": "pz", "oy": "py", "ox": "px"})
    p = T.extract_patches(v, windows)
    p = p.select("volume", *(F.col(a).alias(f"l{a}") for a in "zyx"), *((F.col(a) + F.col(f"p{a}")).alias(a) for a in "zyx"), "val")
    for how in ("gaussian", "average", "max"):
        out = B.blend_patches(p, "val", (4, 4, 4), how)
        assert out.count() == 512
        if how == "gaussian":  # at the rim the weights are no larger than the constant that keeps the quotient finite
            out = out.where("z BETWEEN 2 AND 6 AND y BETWEEN 2 AND 6 AND x BETWEEN 2 AND 6")
        assert one(out.agg(F.max(F.abs(F.col("val") - 0.25)).alias("e")))["e"] < 1e-6
    top = spark.range(1).select(*(F.lit(2).alias(c) for c in ("lz", "ly", "lx"))).select(B.gaussian_weight((4, 4, 4)).alias("w"))
    assert one(top)["w"] == pytest.approx(1)
    with pytest.raises(Exception, match="table"):
        B.score_patches(p, lambda pdf: {"a": 1}, "a int").collect()


def test_turns_go_round(spark):
    df = grid(spark, (2, 3, 4), "z * 100 + y * 10 + x").withColumns({"d": F.lit(2), "h": F.lit(3), "w": F.lit(4)})
    key = lambda x: sorted(map(tuple, x.select("z", "y", "x", "val").collect()))
    assert key(A.rot90(A.rot90(df, 1), 3)) == key(df) == key(A.flip(A.flip(df, ["y"]), ["y"])) == key(A.transpose_xy(A.transpose_xy(df)))
    a = np.array([[0, 1, 2, 3], [10, 11, 12, 13], [20, 21, 22, 23]])
    turned = {(r.y, r.x): r.val for r in A.rot90(df, 1).where("z = 0").collect()}
    assert np.array_equal(np.rot90(a), [[turned[y, x] for x in range(3)] for y in range(4)])


def test_random_draws_dont_depend_on_partitions(spark):
    df = grid(spark).withColumns({"sample_id": F.col("z"), "d": F.lit(4), "h": F.lit(4), "w": F.lit(4), "label": F.lit(1)})
    run = lambda x: sorted(map(tuple, A.augment_pipeline(x, A.train_steps(3)).select("sample_id", "z", "y", "x", "val").collect()))
    assert run(df.repartition(7)) == run(df.coalesce(1))
    noise = A.gaussian_noise(grid(spark, (20, 20, 20), "0"), "val", 1.0, 1, ["z", "y", "x"]).agg(F.avg("val").alias("m"), F.stddev("val").alias("s"))
    assert abs(one(noise)["m"]) < 0.05 and abs(one(noise)["s"] - 1) < 0.05


def test_sampling(spark):
    volumes = spark.createDataFrame([("a", 1, 1, 1), ("b", 1, 1, 9)], "volume string, d int, h int, w int")
    samples = spark.range(2000).withColumnRenamed("id", "i")
    n = {r.volume: r["count"] for r in T.weighted_volume_pick(samples, volumes, 1).groupBy("volume").count().collect()}
    assert sum(n.values()) == 2000 and 120 < n["a"] < 280
    v = grid(spark, (4, 8, 8), "0").withColumn("label", (F.col("x") >= 6).cast("long"))
    s = spark.range(50).selectExpr("id AS i", "'v' AS volume", "4 AS d", "8 AS h", "8 AS w")
    got = T.foreground_crop(s, v, "label", (2, 2, 2), 0.9, 50, 1).collect()
    assert len(got) == 50 and all(r.ratio == 1 and r.x == 6 for r in got)
    best = T.foreground_crop(s, v.withColumn("label", F.lit(0).cast("long")), "label", (2, 2, 2), 0.9, 3, 1).collect()
    assert len(best) == 50 and all(r.ratio == 0 and r.attempt == 0 for r in best)


def test_drops_leave_a_section(spark):
    s = spark.range(200).selectExpr("id AS sample_id", "3 AS d")
    for run in (False, True):
        n = A.random_drops(s, 1, 5, consecutive=run).groupBy("sample_id").count().agg(F.max("count").alias("m"), F.count("*").alias("n"))
        assert one(n) == {"m": 2, "n": 200}


def test_guards(spark):
    df = grid(spark)
    with pytest.raises(ValueError):
        C.permute_axes(df, "y", isotropic=False)
    with pytest.raises(ValueError):
        W.slice_axis(df, df, 3, 0)
    with pytest.raises(ValueError):
        L.raw_term(F.lit(1.0), "no")
    with pytest.raises(ValueError):
        L.class_balance(df, "no")
    with pytest.raises(ValueError):
        L.raw_loss(df)
    with pytest.raises(ValueError):
        A.sem_label_copy(df, "no")
    with pytest.raises(Exception, match="three channels"):
        N.slice_head(spark.createDataFrame([([1.0, 2.0],)], "c array<double>"), "c").collect()


def test_offset_names(spark):
    rows = N.offset_table(spark, [(-1, 0, 0), (0, 3, -4)], 1).orderBy("off").collect()
    assert [r.name for r in rows] == ["00_pull_z-1", "01_push_y+3_x-4"]
    assert W.panel_indices(14, 3, 4) == [0, 1, 2, 3, 5, 7, 9] and W.panel_indices(5, 3) == [0, 1, 2, 3, 4]


def test_array_files(spark, tmp_path):
    a = np.arange(2 * 3 * 4, dtype="<i2").reshape(2, 3, 4)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", a[None])
    paths = spark.createDataFrame([(str(tmp_path / f"{n}.npy"),) for n in "ab"], "path string")
    out = arrays.ingest_volume(spark, paths, slab_bytes=1).toPandas().sort_values(["path", "z", "y", "x"])
    assert out["value"].tolist() == [*range(24), *range(24)]
    with pytest.raises(Exception, match="suffix"):
        arrays.ingest_volume(spark, spark.createDataFrame([("x.foo",)], "path string")).collect()


def test_blocks_round_trip(spark):
    v = grid(spark, (3, 5, 7), "z + y + x").where("NOT (z = 1 AND x = 2)")
    back = arrays.round_trip_blocks(v, ["val"], (2, 2, 4))
    assert sorted(map(tuple, back.select("z", "y", "x", "val").collect())) == sorted(map(tuple, v.select("z", "y", "x", "val").collect()))


def test_scratch_clears(spark):
    s = Scratch(spark, "t")
    df = s.keep_bucketed(spark.range(10), "id", 4)
    assert df.count() == 10 and s.keep(spark.range(3)).count() == 3
    s.clear()
    assert pd.Series([t.name for t in spark.catalog.listTables() if "voxspark" in t.name]).empty


def test_training_order(spark):
    """Sizes, labels and values of the whole order, however the rows are dealt out."""
    df = grid(spark, (4, 6, 8)).withColumns({"sample_id": F.lit(1), "d": F.lit(4), "h": F.lit(6), "w": F.lit(8), "label": (F.when(F.col("x") < 2, 1).when(F.col("x") > 5, 1).otherwise(0)).cast("long"), "val": F.col("val").cast("double")})
    df = df.select("sample_id", "z", "y", "x", "d", "h", "w", "val", "label")
    df = df.withColumns({"rz": F.lit(30), "ry": F.lit(6), "rx": F.lit(6)})
    steps = A.train_steps(5, size=(3, 6, 6), safe_size=(4, 8, 8), boundary_target="both", target=((30, 30), (4, 5), (4, 5)), parts=True, most_missing=1)
    scratch = Scratch(spark, "augment")
    out = sorted(map(tuple, A.augment_pipeline(df, steps, scratch).select("sample_id", "z", "y", "x", "val", "label").collect()))
    scratch.clear()
    assert len(out) == 3 * 6 * 6
    zs = {z: [v for _, k, _, _, v, _ in out if k == z] for z in range(3)}
    assert sum(all(v == 0 for v in vs) for vs in zs.values()) == 1  # the missing section
    both = A.relabel_parts(df).groupBy("label").count().collect()
    assert {r["label"] for r in both} == {0, 1, 2}  # two parts of one label
    sem = A.with_boundaries(df, "semantic")
    assert sem.where("sem_label <> label").count() == sem.where("label = 1 AND (x = 1 OR x = 6)").count() > 0
    centre = A.augment_pipeline(df, A.valid_steps((2, 4, 4), "semantic"))
    assert centre.count() == 32 and {tuple(r) for r in centre.select("d", "h", "w").distinct().collect()} == {(2, 4, 4)}


def test_checksums_with_nulls(spark):
    files = spark.createDataFrame([("a", 1, "x"), ("b", 1, None), ("c", None, None)], "name string, size int, md5 string")
    manifest = spark.createDataFrame([("a", 1, None), ("b", 1, None), ("c", 2, None), ("d", None, None)], "name string, size int, md5 string")
    assert {tuple(r) for r in C.checksum_audit(files, manifest).collect()} == {("a", "mismatch"), ("b", "ok"), ("c", "mismatch"), ("d", "missing")}


def test_crops_pad_and_keep(spark):
    """Every place of a random patch, padded samples too, against slices of a padded array."""
    df = grid(spark, (4, 6, 8), "1 + z * 100 + y * 10 + x").withColumns({"d": F.lit(4), "h": F.lit(6), "w": F.lit(8), "label": (F.col("x") > 5).cast("long")}).drop("volume")
    df = df.crossJoin(spark.range(12).withColumnRenamed("id", "sample_id"))
    a = np.array([[[1 + z * 100 + y * 10 + x for x in range(8)] for y in range(6)] for z in range(4)])
    for size in ((2, 3, 3), (6, 4, 9), (4, 6, 8)):
        pad = [(max(0, s - n) // 2, max(0, s - n) - max(0, s - n) // 2) for s, n in zip(size, a.shape)]
        padded = np.pad(a, pad)
        places = {tuple(padded[z : z + size[0], y : y + size[1], x : x + size[2]].ravel()) for z, y, x in np.ndindex(*(n - s + 1 for n, s in zip(padded.shape, size)))}
        found = set()
        for cut in (A.random_patch(df, size, 3), A.foreground_patch(df, size, 3, 0.3, 20)):
            rows = cut.toPandas().sort_values(["sample_id", "z", "y", "x"])
            assert len(rows) == 12 * np.prod(size) and set(zip(rows["d"], rows["h"], rows["w"])) == {size}
            got = {tuple(v) for v in rows["val"].to_numpy().reshape(12, -1).astype(int)}
            assert got <= places
            found |= got
        assert len(found) > 1 or len(places) == 1
    enough = A.foreground_patch(df, (2, 3, 3), 3, 0.3, 50).groupBy("sample_id").agg(F.avg("label").alias("share")).collect()
    assert all(r.share >= 0.3 for r in enough)


def test_box_counts(spark):
    from voxspark.operators.boxes import box_counts

    rng = np.random.default_rng(2)
    a = rng.integers(0, 2, (6, 9, 11))
    v = spark.createDataFrame([("v", *map(int, i), int(k)) for i, k in np.ndenumerate(a)], "volume string, z int, y int, x int, m long")
    boxes = [(int(k), "v", *map(int, rng.integers(-2, 9, 3)), *map(int, rng.integers(1, 8, 3))) for k in range(60)]
    df = spark.createDataFrame(boxes, "box long, volume string, z int, y int, x int, sz int, sy int, sx int")
    want = {b[0]: int(a[tuple(slice(max(0, i), max(0, i + n)) for i, n in zip(b[2:5], b[5:]))].sum()) for b in boxes}
    for per_task in (3, 100_000):
        got = {r.box: r.n for r in box_counts(v, "m", df, block=(2, 4, 5), per_task=per_task).collect()}
        assert got == {k: n for k, n in want.items() if n}


def zoomed(a, factors, linear):
    """Each voxel of the cut or padded new grid by itself."""
    new = [max(1, round(n * f)) for n, f in zip(a.shape, factors)]
    out = np.zeros(a.shape)
    for i in np.ndindex(a.shape):
        j = [k + ((m - n) // 2 if m >= n else -((n - m) // 2)) for k, n, m in zip(i, a.shape, new)]
        if not all(0 <= k < m for k, m in zip(j, new)):
            continue
        if not linear:
            out[i] = a[tuple(k * n // m for k, n, m in zip(j, a.shape, new))]
            continue
        at = [max((k + 0.5) * n / m - 0.5, 0) for k, n, m in zip(j, a.shape, new)]
        for c in np.ndindex(2, 2, 2):
            w = np.prod([(p - int(p)) if b else 1 - (p - int(p)) for p, b in zip(at, c)])
            out[i] += w * a[tuple(min(int(p) + b, n - 1) for p, b, n in zip(at, c, a.shape))]
    return out


def test_zoom_of_each_sample(spark):
    from voxspark.operators.zoom import zoom_samples

    rng = np.random.default_rng(3)
    shapes = {1: (4, 7, 9), 2: (3, 5, 5), 3: (5, 4, 6), 4: (2, 2, 2), None: (3, 3, 3)}
    factors = {1: (0.5, 1.7, 0.8), 2: (2.0, 0.3, 1.0), 3: (1.0, 1.0, 1.0), None: (1.0, 2.0, 0.5)}  # none for 4
    data = {s: (rng.random(n), rng.integers(0, 5, n)) for s, n in shapes.items()}
    rows = [(s, *map(int, i), float(v[i]), int(k[i])) for s, (v, k) in data.items() for i in np.ndindex(v.shape)]
    df = spark.createDataFrame(rows, "sample_id int, z int, y int, x int, val double, label long")
    of = spark.createDataFrame([(s, *f) for s, f in factors.items()], "sample_id int, zoom_z double, zoom_y double, zoom_x double")
    for block in ((2, 3, 4), (32, 32, 32)):
        got = zoom_samples(df, of, block=block).collect()
        for s, (v, k) in data.items():
            mine = {(r.z, r.y, r.x): r for r in got if r.sample_id == s}
            f = factors.get(s, (1, 1, 1))
            assert len(mine) == v.size
            assert np.allclose([mine[i].val for i in np.ndindex(v.shape)], zoomed(v, f, True).ravel())
            assert [mine[i].label for i in np.ndindex(v.shape)] == zoomed(k, f, False).astype(int).ravel().tolist()


def test_resolutions_draw_their_own_zoom(spark):
    df = grid(spark, (2, 4, 4)).crossJoin(spark.range(6).withColumnRenamed("id", "sample_id")).drop("volume").withColumns({"label": F.lit(1).cast("long"), "d": F.lit(2), "h": F.lit(4), "w": F.lit(4)})
    df = df.withColumns({"rz": F.lit(40), "ry": F.when(F.col("sample_id") % 2 == 0, 4).otherwise(8), "rx": F.when(F.col("sample_id") % 2 == 0, 4).otherwise(8)})
    out = A.rand_zoom(df, ((30, 40), (8, 8), (8, 8)), 1)
    # to 8 nm: samples of 4 nm shrink to half and are padded by zeros, those of 8 nm stay
    share = {r.sample_id: r.share for r in out.groupBy("sample_id").agg(F.avg("label").alias("share")).collect()}
    assert {k: v for k, v in share.items()} == {k: 0.25 if k % 2 == 0 else 1.0 for k in range(6)}
    assert A.rand_zoom(df, ((30, 40), (8, 8), (8, 8)), 1, prob=0.0).where("label = 1 AND val = 0.25").count() == 6 * 32
    union = A.zoom_factors(df.select("sample_id", "rz", "ry", "rx").distinct(), ((20, 20), (4, 4), (4, 4)), "union").collect()
    assert all((r.zoom_z, r.zoom_y) == pytest.approx((2.0, r.ry / 4)) for r in union)


def test_reflection_keeps_ramps_and_constants(spark):
    """Volumes shorter than the window and last strides beyond the face, blended right at all faces."""
    sizes = [("a", 3, 9, 8), ("b", 1, 4, 5), ("c", 12, 4, 4)]
    volumes = spark.createDataFrame(sizes, "volume string, d int, h int, w int")
    v = volumes.selectExpr("volume", "explode(sequence(0, d - 1)) AS z", "h", "w").selectExpr("volume", "z", "explode(sequence(0, h - 1)) AS y", "w").selectExpr("volume", "z", "y", "explode(sequence(0, w - 1)) AS x")
    for value, how in (("0.25D", "average"), ("0.25D", "max"), ("CAST(z + 10 * y + 100 * x AS DOUBLE)", "average")):
        df = v.withColumn("val", F.expr(value))
        out = B.slide(df, volumes, "val", lambda pdf: pdf, (4, 4, 4), (3, 3, 3), how)
        both = out.withColumnRenamed("val", "got").join(df, ["volume", "z", "y", "x"])
        assert both.count() == v.count() == out.count()
        assert one(both.agg(F.max(F.abs(F.col("got") - F.col("val"))).alias("e")))["e"] < 1e-4
    padded = B.reflect_pad(v.withColumn("val", F.expr("z + 10 * y + 100 * x")), volumes, (4, 4, 4), (3, 3, 3)).where("volume = 'a'").collect()
    want = np.pad(np.add.outer(np.add.outer(np.arange(3), 10 * np.arange(9)), 100 * np.arange(8)), ((0, 1), (0, 1), (0, 2)), mode="reflect")
    assert {(r.z, r.y, r.x): r.val for r in padded} == {i: k for i, k in np.ndenumerate(want)}


def test_running_totals(spark):
    from voxspark.operators.prefix import consecutive, running_total

    rng = np.random.default_rng(4)
    rows = [(int(k), int(w) if w else None) for k, w in zip(rng.permutation(500), rng.integers(0, 9, 500))]
    df = spark.createDataFrame(rows, "k long, w long").repartition(6)
    got = {r.k: r.before for r in running_total(df, ["k"], "w", Scratch(spark, "t")).collect()}
    total, want = 0, {}
    for k, w in sorted(rows):
        want[k] = total
        total += w or 0
    assert got == want
    assert {r.k: r["rank"] for r in consecutive(df, "k", Scratch(spark, "t")).collect()} == {k: k + 1 for k in range(500)}
    assert running_total(df.limit(0), ["k"], "w", Scratch(spark, "t")).collect() == []


def test_expected_information_of_large_clusters(spark):
    """A few clusters of many voxels: all terms of the sum against those within the bound."""
    from voxspark.operators import metrics as M

    cells = {(1, 1): 90_000, (1, 2): 30_000, (2, 1): 20_000, (2, 2): 60_000, (3, 3): 40}
    df = None
    for (t, p), n in cells.items():
        part = spark.range(n).select(F.lit(t).cast("long").alias("true"), F.lit(p).cast("long").alias("pred"))
        df = part if df is None else df.unionByName(part)
    n = sum(cells.values())
    a = [sum(v for (t, _), v in cells.items() if t == k) for k in (1, 2, 3)]
    b = [sum(v for (_, p), v in cells.items() if p == k) for k in (1, 2, 3)]
    lg = math.lgamma
    emi = 0.0
    for x in a:
        for y in b:
            for k in range(max(1, x + y - n), min(x, y) + 1):
                log_p = lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1) - lg(k + 1) - lg(x - k + 1) - lg(y - k + 1) - lg(n - x - y + k + 1)
                emi += k / n * math.log(n * k / (x * y)) * math.exp(log_p)
    entropy = lambda c: -sum(v / n * math.log(v / n) for v in c)
    mi = sum(v / n * math.log(n * v / (a[t - 1] * b[p - 1])) for (t, p), v in cells.items())
    assert one(M.ami(df))["ami"] == pytest.approx((mi - emi) / ((entropy(a) + entropy(b)) / 2 - emi), abs=1e-7)


def test_lines_of_boxes_are_not_broadcast(spark):
    from voxspark.operators.catalog import crop_boxes

    voxels = spark.range(200).select(F.lit("v").alias("volume"), F.lit(0).alias("z"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"))
    one = spark.createDataFrame([("v", 150)], "volume string, n int").groupBy("volume").agg(F.max("n").alias("n"))  # few bytes, and many boxes
    boxes = one.select("volume", F.lit(0).alias("z"), F.lit(0).alias("y"), F.explode(F.sequence(F.lit(0), F.col("n"))).alias("x"), *(F.lit(1).alias(s) for s in ("sz", "sy")), F.lit(20).alias("sx"), F.lit("b").alias("name"))
    out = crop_boxes(voxels, boxes)
    assert len(out.collect()) == 151 * 20
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
