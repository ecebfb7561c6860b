"""Queries over segmentations: neighbours, graphs, regions, blending, metrics, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blend as B, graph as G, losses as L, metrics as M, neighbors as N, region as R
from ..sources import arrays as S
from .fixtures import L1, VOLUMES, l1, table, v1, volumes_of, with_v1
from .registry import query
from .volume_queries import r6

BLOCK = (4, 32, 32)
OFFSETS = [(-1, 0, 0), (0, -1, 0), (0, 0, -1), (0, -3, 0), (-1, 2, 4)]
N_PULL = 3
O = "o(off, dz, dy, dx) AS (VALUES " + ", ".join(f"({k}, {z}, {y}, {x})" for k, (z, y, x) in enumerate(OFFSETS)) + ")"  # noqa: E741
NEAR = "n AS (SELECT v.z, v.y, v.x, off, v.gt, v.val, b.gt AS other FROM v JOIN vol USING (volume) CROSS JOIN o JOIN v b ON b.z = least(greatest(v.z + dz, 0), d - 1) AND b.y = least(greatest(v.y + dy, 0), h - 1) AND b.x = least(greatest(v.x + dx, 0), w - 1))"
STEPS4 = "s(dz, dy, dx) AS (VALUES (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))"
STEPS6 = "s(dz, dy, dx) AS (VALUES (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1), (-1, 0, 0), (1, 0, 0))"
EDGE = "t AS (SELECT v.z, v.y, v.x, any_value(v.gt) AS gt, bool_or(b.gt <> v.gt) AS differs FROM v CROSS JOIN s JOIN v b ON b.z = v.z + dz AND b.y = v.y + dy AND b.x = v.x + dx GROUP BY v.z, v.y, v.x)"


def gt(spark, d):
    return v1(spark, d).withColumnRenamed("gt", "label")


@query(with_v1("SELECT z, y, x, differs AND gt > 0 AS boundary FROM t", STEPS4, EDGE))
def boundaries_xy(spark, d):
    return N.boundaries(gt(spark, d), mode="inner", xy_only=True, block=BLOCK).select("z", "y", "x", "boundary")


@query(with_v1("SELECT z, y, x, differs AND gt = 0 AS boundary FROM t", STEPS4, EDGE))
def boundaries_xy_outer(spark, d):
    return N.boundaries(gt(spark, d), mode="outer", xy_only=True, block=BLOCK).select("z", "y", "x", "boundary")


@query(with_v1("SELECT z, y, x, differs AS boundary FROM t", STEPS6, EDGE))
def boundaries_3d(spark, d):
    return N.boundaries(gt(spark, d), mode="thick", block=BLOCK).select("z", "y", "x", "boundary")


@query(with_v1("SELECT v.z // 5 AS sample_id, v.z, v.y, v.x, v.gt > 0 AND bool_or(b.gt <> v.gt) AS boundary FROM v CROSS JOIN s JOIN v b ON b.z = v.z + dz AND b.y = v.y + dy AND b.x = v.x + dx AND b.z // 5 = v.z // 5 GROUP BY v.z, v.y, v.x, v.gt", STEPS6))
def boundary_mask_batch(spark, d):
    df = gt(spark, d).withColumns({"sample_id": F.floor(F.col("z") / 5), "z": F.col("z") % 5})
    out = N.boundaries(df, mode="inner", by=["sample_id"], block=BLOCK)
    return out.select("sample_id", (F.col("z") + F.col("sample_id") * 5).alias("z"), "y", "x", "boundary")


@query(with_v1("SELECT z, y, x, CASE WHEN differs AND gt > 0 THEN 0 ELSE gt END AS label FROM t", STEPS4, EDGE))
def erode_boundaries(spark, d):
    return N.erode_boundaries(gt(spark, d), pixel_size=(40, 8, 8)).select("z", "y", "x", "label")


@query(with_v1("SELECT z, y, x, gt AS label, CASE WHEN differs AND gt > 0 THEN 0 ELSE gt END AS sem_label FROM t", STEPS4, EDGE))
def sem_label_copy(spark, d):
    from ..operators.augment import sem_label_copy as copy

    return copy(N.boundaries(gt(spark, d), xy_only=True, block=BLOCK), "semantic").select("z", "y", "x", "label", "sem_label")


@query(with_v1("SELECT v.z, v.y, v.x, b.val FROM v JOIN vol USING (volume) JOIN v b ON b.z = least(greatest(v.z + 2, 0), d - 1) AND b.y = least(greatest(v.y - 5, 0), h - 1) AND b.x = least(greatest(v.x + 7, 0), w - 1)", VOLUMES))
def shift_nd(spark, d):
    return N.shift(v1(spark, d), (2, -5, 7), "val", block=BLOCK).select("z", "y", "x", "val")


@query(with_v1("SELECT z, y, x, off, CASE WHEN gt = other THEN 1 ELSE 0 END AS aff FROM n", VOLUMES, O, NEAR))
def affinity_targets(spark, d):
    return N.affinity_targets(gt(spark, d), OFFSETS).select("z", "y", "x", F.posexplode("aff").alias("off", "aff")).withColumn("aff", F.col("aff").cast("int"))


@query(with_v1("SELECT z, y, x, off, CASE WHEN gt > 0 AND other > 0 THEN 1 ELSE 0 END AS valid FROM n", VOLUMES, O, NEAR))
def affinity_validity(spark, d):
    return N.affinity_validity(gt(spark, d), OFFSETS).select("z", "y", "x", F.posexplode("valid").alias("off", "valid")).withColumn("valid", F.col("valid").cast("int"))


@query(with_v1("SELECT off, count(*) AS n, CAST(sum(CASE WHEN gt = other THEN 1 ELSE 0 END) AS BIGINT) AS same, CAST(sum(CASE WHEN gt > 0 AND other > 0 THEN 1 ELSE 0 END) AS BIGINT) AS valid FROM n GROUP BY off", VOLUMES, O, NEAR))
def channel_targets(spark, d):
    e = N.channel_targets(gt(spark, d), OFFSETS).select(F.posexplode(F.arrays_zip("aff", "valid")).alias("off", "e"))
    return e.groupBy("off").agg(F.count("*").alias("n"), F.sum(F.col("e.aff").cast("long")).alias("same"), F.sum(F.col("e.valid").cast("long")).alias("valid"))


def head(spark, d):
    """Voxels with pseudo affinities: aff = clamp(0.5 +- 0.35 + val), their logits, a semantic logit and a raw value."""
    t = N.affinities(gt(spark, d), OFFSETS, block=BLOCK, carry=["val"])
    prob = F.transform("aff", lambda a: F.least(F.greatest(F.lit(0.5) + F.when(a == 1, 0.35).otherwise(-0.35) + F.col("val"), F.lit(0.0)), F.lit(1.0)))
    logit = F.transform("prob", lambda p: F.log(F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7)) / (1 - F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7)))))
    return t.withColumn("prob", prob).withColumns({"aff_logit": logit, "sem": F.col("val") * 10, "raw": F.col("val"), "image": F.col("val") * 0.5 + 0.1})


H = "hd AS (SELECT *, CASE WHEN gt = other THEN 1.0 ELSE 0.0 END AS t, CASE WHEN gt > 0 AND other > 0 THEN 1.0 ELSE 0.0 END AS valid, least(greatest(0.5 + CASE WHEN gt = other THEN 0.35 ELSE -0.35 END + val, 0), 1) AS prob FROM n), lg AS (SELECT *, ln(least(greatest(prob, 1e-7), 1 - 1e-7) / (1 - least(greatest(prob, 1e-7), 1 - 1e-7))) AS l FROM hd)"
EDGES = f"""ed AS (SELECT (hd.z * h + hd.y) * w + hd.x AS u, ((hd.z + dz) * h + hd.y + dy) * w + hd.x + dx AS v, CAST(CASE WHEN off < {N_PULL} THEN CAST(prob AS FLOAT) ELSE CAST(1 AS FLOAT) - CAST(prob AS FLOAT) END AS DOUBLE) AS w, off, off >= {N_PULL} AS is_mutex FROM hd JOIN o USING (off) CROSS JOIN vol
WHERE hd.z + dz BETWEEN 0 AND d - 1 AND hd.y + dy BETWEEN 0 AND h - 1 AND hd.x + dx BETWEEN 0 AND w - 1 AND (off < {N_PULL} OR ((hd.y - greatest(0, -dy)) % 4 = 0 AND (hd.x - greatest(0, -dx)) % 4 = 0)))"""


@query(with_v1("SELECT CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, round(w, 6) AS w, off, is_mutex FROM ed", VOLUMES, O, NEAR, H, EDGES))
def build_edges(spark, d):
    return r6(N.build_edges(head(spark, d), OFFSETS, N_PULL, "prob", shapes=volumes_of(v1(spark, d))), "w").select("u", "v", "w", "off", "is_mutex")


@query(with_v1("SELECT CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, off FROM ed WHERE NOT is_mutex UNION ALL SELECT u, v, off FROM (SELECT CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, off FROM ed WHERE is_mutex ORDER BY w DESC, off, u LIMIT 500)", VOLUMES, O, NEAR, H, EDGES))
def cap_push_edges(spark, d):
    return N.cap_push_edges(N.build_edges(head(spark, d), OFFSETS, N_PULL, "prob", shapes=volumes_of(v1(spark, d))), 500).select("u", "v", "off")


LINKS = "li AS (SELECT o_custkey AS a, o_custkey * 7 % 1499 + 1 AS b FROM orders)"
REACH = """li2 AS (SELECT a, b FROM li UNION SELECT b, a FROM li), nodes AS (SELECT DISTINCT a AS node FROM li2),
cc(node, root) AS (SELECT node, node FROM nodes UNION SELECT li2.b, cc.root FROM cc JOIN li2 ON li2.a = cc.node AND cc.root < li2.b)"""


@query(f"WITH RECURSIVE {LINKS}, {REACH} SELECT node, min(root) AS root FROM cc GROUP BY node")
def resolve_roots(spark, d):
    o = table(spark, d, "orders")
    return G.resolve_roots(o.select(F.col("o_custkey").cast("long").alias("a"), (F.col("o_custkey") * 7 % 1499 + 1).cast("long").alias("b")))


@query()
def label_components(spark, d):
    return G.label_components(gt(spark, d), min_voxels=50, block=BLOCK).select("z", "y", "x", "component")


@query()
def label_binary(spark, d):
    return G.label_binary(gt(spark, d).withColumn("mask", F.col("val") > 0.05), "mask").select("z", "y", "x", "component")


@query()
def mutex_watershed(spark, d):
    h = head(spark, d).withColumns({"sample_id": F.floor(F.col("z") / 5), "z": F.col("z") % 5})
    return G.agglomerate(h, OFFSETS, N_PULL, "prob", strides=(1, 2, 2), by=["sample_id"])


@query()
def agglomerate(spark, d):
    h = head(spark, d).withColumns({"sample_id": F.floor(F.col("z") / 5), "z": F.col("z") % 5, "fg": F.col("sem") > 0})
    return G.agglomerate(h, OFFSETS, N_PULL, "prob", "fg", (1, 2, 2), 10, 100_000, ["sample_id"])


@query()
def boundaries_3d_outer(spark, d):
    return N.boundaries(gt(spark, d), mode="outer", connectivity=3, block=BLOCK).select("z", "y", "x", "boundary")


@query()
def mutex_watershed_stitched(spark, d):
    """Crops of six sections that overlap in two, joined where they agree."""
    from ..operators.catalog import crop_boxes
    from ..operators.tiling import tile_patches

    h = head(spark, d)
    crops = tile_patches(volumes_of(h), (6, 50, 64), 0.34).select(F.col("patch_idx").alias("crop"), "volume", "z", "y", "x", "sz", "sy", "sx").withColumn("z0", F.col("z"))
    cut = crop_boxes(h.select("volume", "z", "y", "x", "prob"), crops, 32)
    labels = G.agglomerate(cut, OFFSETS, N_PULL, "prob", strides=(1, 2, 2), by=["crop"]).join(crops.select("crop", "z0"), "crop")
    node = ((F.col("z") + F.col("z0")).cast("long") * 50 + F.col("y")) * 64 + F.col("x")
    return G.stitch(labels.select("crop", node.alias("node"), "label"))


@query(with_v1("SELECT z, y, x, CASE WHEN gt IN (0, 1) THEN 0 ELSE (SELECT count(DISTINCT b.gt) FROM v b WHERE b.gt <= v.gt AND b.gt NOT IN (0, 1)) END AS gt FROM v"))
def relabel_consecutive(spark, d):
    return G.relabel_consecutive(v1(spark, d).select("z", "y", "x", "gt"), "gt", ignore=1)


@query(with_v1("SELECT z, y, x, CASE WHEN lost = 0 THEN gt WHEN n >= 640 AND gt > 0 THEN CAST(r AS BIGINT) ELSE 0 END AS gt FROM v JOIN (SELECT gt, n, sum(CASE WHEN n < 640 AND gt > 0 THEN 1 ELSE 0 END) OVER () AS lost, sum(CASE WHEN n >= 640 AND gt > 0 THEN 1 ELSE 0 END) OVER (ORDER BY gt) AS r FROM (SELECT gt, count(*) AS n FROM v GROUP BY gt)) USING (gt)"))
def size_filter(spark, d):
    return G.size_filter(v1(spark, d), 640, "gt").select("z", "y", "x", "gt")


BALL = "s AS (SELECT CAST(a AS INTEGER) AS dz, CAST(b AS INTEGER) AS dy, CAST(c AS INTEGER) AS dx, a * a * 4 + b * b + c * c AS far FROM range(-1, 2) r(a), range(-3, 4) q(b), range(-3, 4) p(c) WHERE a * a * 4 + b * b + c * c <= 9)"


@query(with_v1("SELECT v.z, v.y, v.x, CASE WHEN any_value(v.gt) <> 0 THEN any_value(v.gt) ELSE coalesce(arg_min(b.gt, (far, b.z, b.y, b.x)), 0) END AS gt FROM v CROSS JOIN s LEFT JOIN v b ON b.z = v.z + dz AND b.y = v.y + dy AND b.x = v.x + dx AND b.gt <> 0 GROUP BY v.z, v.y, v.x", BALL).replace("coalesce(arg_min(b.gt, (far, b.z, b.y, b.x)), 0)", "coalesce(arg_min(b.gt, far * 100000000 + b.z * 10000 + b.y * 100 + b.x) FILTER (WHERE b.gt IS NOT NULL), 0)"))
def grow_labels(spark, d):
    return G.grow_labels(v1(spark, d), "gt", 3, (2.0, 1.0, 1.0), block=BLOCK).select("z", "y", "x", "gt")


@query(with_v1("SELECT a.z, a.y, a.x, round(min(sqrt(CASE WHEN b.val > 0.1 THEN NULL ELSE 4 * (a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2 END)), 6) AS distance FROM v a JOIN v b ON abs(a.z - b.z) <= 2 AND abs(a.y - b.y) <= 4 AND abs(a.x - b.x) <= 4 GROUP BY a.z, a.y, a.x"))
def edt(spark, d):
    return r6(R.edt(v1(spark, d).withColumn("mask", F.col("val") > 0.1), "mask", (2.0, 1.0, 1.0)), "distance").select("z", "y", "x", "distance")


@query(with_v1("""SELECT v.z, t.i AS y, v.x, round(sum(val * k), 6) AS val FROM v JOIN (SELECT i, CASE WHEN i + o < 0 THEN -1 - i - o WHEN i + o > 49 THEN 99 - i - o ELSE i + o END AS y, exp(-0.5 * (o / 1.5) ** 2) / (SELECT sum(exp(-0.5 * (q / 1.5) ** 2)) FROM range(-6, 7) w(q)) AS k FROM (SELECT CAST(range AS INTEGER) AS i FROM range(0, 50)), (SELECT CAST(range AS INTEGER) AS o FROM range(-6, 7))) t ON v.y = t.y GROUP BY v.z, t.i, v.x"""))
def gaussian_filter(spark, d):
    return r6(R.gaussian_filter(v1(spark, d), "val", (0.0, 1.5, 0.0), block=BLOCK), "val").select("z", "y", "x", "val")


@query(with_v1("SELECT p_partkey AS label, round(avg(z), 6) AS cz, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx FROM part LEFT JOIN v ON gt = p_partkey AND gt > 0 GROUP BY p_partkey"))
def centroids(spark, d):
    ids = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("label"))
    return r6(R.centroids(gt(spark, d), ids=ids), "cz", "cy", "cx").select("label", "cz", "cy", "cx")


@query(with_v1("SELECT z % 4 AS lz, y % 8 AS ly, x % 8 AS lx, round(exp(-((z % 4 - 2) ** 2 + (y % 8 - 4) ** 2 + (x % 8 - 4) ** 2) / (2 * 0.5 ** 2)), 6) AS weight FROM v"))
def gaussian_weights(spark, d):
    df = v1(spark, d).select((F.col("z") % 4).alias("lz"), (F.col("y") % 8).alias("ly"), (F.col("x") % 8).alias("lx"))
    return df.withColumn("weight", F.round(B.gaussian_weight((4, 8, 8)), 6))


GRID = "s AS (SELECT p_partkey AS volume, 5 + p_partkey % 20 AS d FROM part)"


@query(f"WITH {GRID} SELECT DISTINCT volume, CAST(z AS INTEGER) AS z, 0 AS y, 0 AS x FROM (SELECT volume, unnest(list_append(list_transform(range(0, greatest(1, (d - 8 + 3) // 3)), lambda i: least(i * 3, greatest(d, 8) - 8)), greatest(d, 8) - 8)) AS z FROM s)")
def window_grid(spark, d):
    s = table(spark, d, "part").select(F.col("p_partkey").alias("volume"), (5 + F.col("p_partkey") % 20).cast("int").alias("d"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    return B.window_grid(s, (8, 8, 8), (3, 3, 3))


def scored(spark, d):
    """Voxels of overlapping windows with a model's value: val plus the window's z / 10."""
    from ..operators.tiling import extract_patches

    v = v1(spark, d)
    w = B.window_grid(volumes_of(v), (4, 50, 64), (3, 50, 64)).withColumns({"sz": F.lit(4), "sy": F.lit(50), "sx": F.lit(64), "pz": F.col("z")})
    p = extract_patches(v.select("volume", "z", "y", "x", "val"), w)

    def model(pdf):
        return pdf.assign(val=pdf["val"] + pdf["pz"] / 10)

    out = B.score_patches(p.select("volume", "pz", "z", "y", "x", "val"), model, "volume string, pz int, z int, y int, x int, val double")
    return out.select("volume", F.col("z").alias("lz"), F.col("y").alias("ly"), F.col("x").alias("lx"), (F.col("z") + F.col("pz")).alias("z"), "y", "x", "val")


WIN = "win AS (SELECT DISTINCT unnest(list_append(list_transform(range(0, greatest(1, (d - 4 + 3) // 3)), lambda i: least(i * 3, d - 4)), d - 4)) AS pz FROM vol), sc AS (SELECT v.z, v.y, v.x, v.z - pz AS lz, val + pz / 10 AS val FROM v JOIN win ON v.z >= pz AND v.z < pz + 4)"


@query(with_v1("SELECT CAST(z AS INTEGER) AS z, y, x, CAST(lz AS INTEGER) AS lz, round(val, 6) AS val FROM sc", VOLUMES, WIN))
def score_patches(spark, d):
    return r6(scored(spark, d), "val").select("z", "y", "x", "lz", "val")


@query(with_v1("SELECT z, y, x, round(sum(val) / (count(*) + 1e-8), 6) AS val FROM sc GROUP BY z, y, x", VOLUMES, WIN))
def blend_average(spark, d):
    return r6(B.blend_patches(scored(spark, d), "val", (4, 50, 64), "average"), "val").select("z", "y", "x", "val")


@query(with_v1("SELECT z, y, x, round(greatest(max(val), 0), 6) AS val FROM sc GROUP BY z, y, x", VOLUMES, WIN))
def blend_max(spark, d):
    return r6(B.blend_patches(scored(spark, d), "val", (4, 50, 64), "max", floor_zero=True), "val").select("z", "y", "x", "val")


def pair(spark, d):
    return v1(spark, d).select(F.floor(F.col("z") / 5).alias("sample_id"), "z", "y", "x", F.col("gt").alias("true"), F.col("pr").alias("pred"))


def sums_sql(source: str, sample: str) -> str:
    return f"""p AS (SELECT {sample} AS s, true_, pred FROM ({source}) WHERE true_ > 0 OR pred > 0), c AS (SELECT s, true_, pred, count(*) AS n FROM p GROUP BY ALL),
a AS (SELECT s, true_, sum(n) AS n FROM c GROUP BY ALL), b AS (SELECT s, pred, sum(n) AS n FROM c GROUP BY ALL),
m AS (SELECT s, N, cells, nt, np, sq, ln_, sqa, lna, sqb, lnb FROM (SELECT s, sum(n) AS N, count(*) AS cells, sum(CAST(n AS DOUBLE) * n) AS sq, sum(n * ln(n)) AS ln_ FROM c GROUP BY s) JOIN (SELECT s, count(*) AS nt, sum(CAST(n AS DOUBLE) * n) AS sqa, sum(n * ln(n)) AS lna FROM a GROUP BY s) USING (s) JOIN (SELECT s, count(*) AS np, sum(CAST(n AS DOUBLE) * n) AS sqb, sum(n * ln(n)) AS lnb FROM b GROUP BY s) USING (s))"""


VP = "SELECT z // 5 AS sample_id, gt AS true_, pr AS pred FROM v"
ONE = sums_sql("SELECT * FROM l", "sample_id")
V1P = sums_sql(VP, "sample_id")
ALL = sums_sql(VP, "0")
ARI = "greatest(2 * ((sq - N) * (CAST(N AS DOUBLE) * N - sqa - sqb + sq) - (sqa - sq) * (sqb - sq)) / ((sq - N + sqa - sq) * (sqa - sq + CAST(N AS DOUBLE) * N - sqa - sqb + sq) + (sq - N + sqb - sq) * (sqb - sq + CAST(N AS DOUBLE) * N - sqa - sqb + sq)), 0)"


@query(with_v1("SELECT z, y, x FROM v WHERE gt > 0 OR pr > 0"))
def prepare_labels(spark, d):
    return M.prepare_labels(pair(spark, d)).select("z", "y", "x")


@query(f"WITH {L1} SELECT sample_id, true_ AS true_id, pred AS pred_id, count(*) AS n FROM l GROUP BY ALL")
def contingency(spark, d):
    return M.contingency(l1(spark, d), ["sample_id"]).select("sample_id", F.col("true").alias("true_id"), F.col("pred").alias("pred_id"), "n")


@query(f"WITH {L1}, {ONE} SELECT s AS sample_id, round({ARI}, 6) AS ari FROM m")
def ari(spark, d):
    return r6(M.ari(l1(spark, d), ["sample_id"]), "ari")


@query(with_v1(f"SELECT s AS sample_id, round({ARI}, 6) AS ari FROM m", V1P))
def ari_volume(spark, d):
    return r6(M.ari(pair(spark, d), ["sample_id"]), "ari")


AMI = """f AS (SELECT s, sa.n AS a, count(*) AS ma FROM a sa GROUP BY ALL), g AS (SELECT s, sb.n AS b, count(*) AS mb FROM b sb GROUP BY ALL),
t AS (SELECT s, a, b, ma, mb, N, unnest(range(CAST(greatest(1, a + b - N) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1)) AS k FROM f JOIN g USING (s) JOIN m USING (s)),
emi AS (SELECT s, sum(ma * mb * (k / N) * (ln(N) + ln(k) - ln(a) - ln(b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(N - a + 1) + lgamma(N - b + 1) - lgamma(N + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(N - a - b + k + 1))) AS emi FROM t GROUP BY s)"""


@query(with_v1("SELECT s AS sample_id, round(greatest(((ln_ - lna - lnb) / N + ln(N) - emi) / ((2 * ln(N) - lna / N - lnb / N) / 2 - emi), 0), 6) AS ami FROM m JOIN emi USING (s)", V1P, AMI))
def ami(spark, d):
    return r6(M.ami(pair(spark, d), ["sample_id"]), "ami")


@query(f"WITH {L1}, {ONE} SELECT s AS sample_id, round((lna - ln_) / N / ln(2), 6) AS voi_split, round((lnb - ln_) / N / ln(2), 6) AS voi_merge, round((lna + lnb - 2 * ln_) / N / ln(2), 6) AS voi FROM m")
def voi_clustering(spark, d):
    return r6(M.voi(l1(spark, d), ["sample_id"]), "voi_split", "voi_merge", "voi")


@query(with_v1("SELECT s AS sample_id, round((lna - ln_) / N / ln(2), 6) AS voi_split, round((lnb - ln_) / N / ln(2), 6) AS voi_merge, round((lna + lnb - 2 * ln_) / N / ln(2), 6) AS voi FROM m", V1P))
def voi(spark, d):
    return r6(M.voi(pair(spark, d), ["sample_id"]), "voi_split", "voi_merge", "voi")


@query(f"WITH {L1}, {ONE} SELECT s AS sample_id, CAST(2 * cells - nt - np AS BIGINT) AS ted FROM m")
def ted(spark, d):
    return M.ted(l1(spark, d), ["sample_id"])


@query(with_v1(f"SELECT round(avg({ARI}), 6) AS ari, round(avg((lna - ln_) / N / ln(2)), 6) AS voi_split, round(avg((lnb - ln_) / N / ln(2)), 6) AS voi_merge, round(avg((lna - ln_) / N / ln(2)) + avg((lnb - ln_) / N / ln(2)), 6) AS voi, round(avg(2 * cells - nt - np), 6) AS ted FROM m", V1P))
def metrics_batch(spark, d):
    p = pair(spark, d)
    per = M.ari(p, ["sample_id"]).join(M.voi(p, ["sample_id"]).drop("voi"), "sample_id").join(M.ted(p, ["sample_id"]), "sample_id")
    return r6(M.batch_mean(per, ["ari", "voi_split", "voi_merge", "ted"]), "ari", "voi_split", "voi_merge", "voi", "ted")


@query(with_v1("SELECT round((lna - ln_) / N / ln(2), 6) AS voi_split, round((lnb - ln_) / N / ln(2), 6) AS voi_merge, round((lna + lnb - 2 * ln_) / N / ln(2), 6) AS voi FROM m", ALL))
def voi_pooled(spark, d):
    return r6(M.voi(pair(spark, d)), "voi_split", "voi_merge", "voi")


CLASSES = "q AS (SELECT doc_id % 10 AS s, sum(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END) AS i0, sum(1 - quality) AS t0, sum(1 - toxic) AS p0, sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS i1, sum(quality) AS t1, sum(toxic) AS p1, avg(CASE WHEN quality = toxic THEN 1 ELSE 0 END) AS acc FROM labels GROUP BY ALL), di AS (SELECT s, (CASE WHEN t0 + p0 > 0 THEN 2.0 * i0 / (t0 + p0) ELSE 1 END + CASE WHEN t1 + p1 > 0 THEN 2.0 * i1 / (t1 + p1) ELSE 1 END) / 2 AS dice, CASE WHEN t1 > 0 THEN 1.0 * i1 / (t1 + p1 - i1) ELSE 0 END AS iou, acc FROM q)"


def masks(spark, d):
    return table(spark, d, "labels").select((F.col("doc_id") % 10).alias("sample_id"), F.col("quality").alias("true"), F.col("toxic").alias("pred"))


@query(f"WITH {CLASSES} SELECT s AS sample_id, round(dice, 6) AS dice FROM di")
def dice(spark, d):
    return r6(M.dice(masks(spark, d), ["sample_id"]), "dice")


@query(f"WITH {CLASSES} SELECT s AS sample_id, round(iou, 6) AS iou FROM di")
def iou(spark, d):
    return r6(M.iou(masks(spark, d), ["sample_id"]), "iou")


@query(f"WITH {CLASSES} SELECT round(avg(dice), 6) AS dice, round(avg(iou), 6) AS iou, round(avg(acc), 6) AS accuracy FROM di")
def semantic_batch(spark, d):
    m = masks(spark, d)
    per = M.dice(m, ["sample_id"]).join(M.iou(m, ["sample_id"]), "sample_id").join(M.accuracy(m, ["sample_id"]), "sample_id")
    return r6(M.batch_mean(per, ["dice", "iou", "accuracy"]), "dice", "iou", "accuracy")


@query(with_v1("""SELECT s AS sample_id, round(acc, 6) AS accuracy, round(CASE WHEN t1 > 0 THEN i1 / (t1 + p1 - i1) ELSE 0 END, 6) AS iou, round((2 * i0 / (t0 + p0) + 2 * i1 / (t1 + p1)) / 2, 6) AS dice FROM
(SELECT z // 5 AS s, avg(CASE WHEN p = t THEN 1 ELSE 0 END) AS acc, sum(p * t) AS i1, sum(t) AS t1, sum(p) AS p1, sum((1 - p) * (1 - t)) AS i0, sum(1 - t) AS t0, sum(1 - p) AS p0 FROM (SELECT z, CASE WHEN 1 / (1 + exp(-val * 10)) > 0.5 THEN 1.0 ELSE 0 END AS p, CASE WHEN gt > 0 THEN 1.0 ELSE 0 END AS t FROM v) GROUP BY s)"""))
def semantic_report(spark, d):
    h = gt(spark, d).select(F.floor(F.col("z") / 5).alias("sample_id"), "label", (F.col("val") * 10).alias("sem"))
    return r6(M.semantic_report(h, ["sample_id"]), "accuracy", "iou", "dice")


REPORT = sums_sql(VP + " WHERE gt > 0", "sample_id")


@query(with_v1(f"""SELECT s AS sample_id, metric, round(value, 6) AS value FROM (SELECT s, {ARI} AS ari, greatest(((ln_ - lna - lnb) / N + ln(N) - emi) / ((2 * ln(N) - lna / N - lnb / N) / 2 - emi), 0) AS ami, (lna + lnb - 2 * ln_) / N / ln(2) AS voi, (lna - ln_) / N / ln(2) AS voi_split, (lnb - ln_) / N / ln(2) AS voi_merge, CAST(2 * cells - nt - np AS DOUBLE) AS ted FROM m JOIN emi USING (s)) UNPIVOT (value FOR metric IN (ari, ami, voi, voi_split, voi_merge, ted))""", REPORT, AMI))
def instance_report(spark, d):
    return r6(M.instance_report(pair(spark, d), ["sample_id"]), "value")


@query("SELECT event_type AS key, round(sum(value * (user_id % 5)) / sum(user_id % 5), 6) AS mean, CAST(sum(user_id % 5) AS BIGINT) AS weight FROM events GROUP BY event_type HAVING sum(user_id % 5) > 0")
def metric_accumulate(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("value").cast("double").alias("value"), (F.col("user_id") % 5).cast("long").alias("weight"))
    return r6(M.metric_accumulate(e, "key", "value", "weight"), "mean").select("key", "mean", F.col("weight").cast("long").alias("weight"))


def composite_sql(rows: str, cfg: L.LossConfig, name: str) -> str:
    return f"""SELECT round({cfg.lambda_bce} * sum(bce * wm) / greatest(sum(wm), 1) + {cfg.lambda_focal} * sum(pow(1 - (p * t + (1 - p) * (1 - t)), {cfg.gamma}) * bce * wm) / greatest(sum(wm), 1)
+ {cfg.lambda_dice} * (1 - (2 * sum(p * t * wm) + {cfg.eps}) / (sum(p * wm) + sum(t * wm) + {cfg.eps})), 6) AS {name} FROM (SELECT *, 1 / (1 + exp(-l)) AS p, greatest(l, 0) - l * t + ln(1 + exp(-abs(l))) AS bce FROM ({rows}))"""


CFG = L.LossConfig(lambda_focal=0.5, push_weight=0.5, n_pull=N_PULL, class_balance="auto", weight_raw=0.25)
BALANCED = f"SELECT l, t, wq * CASE WHEN t > 0.5 THEN least(0.5 / f, 10) ELSE least(0.5 / (1 - f), 10) END AS wm FROM (SELECT *, sum(t * wq) OVER (PARTITION BY off) / sum(wq) OVER (PARTITION BY off) AS f FROM (SELECT off, l, t, valid * CASE WHEN off < {N_PULL} THEN 1.0 ELSE 0.5 END AS wq FROM lg))"
SEM = "SELECT val * 10 AS l, t, CASE WHEN t > 0.5 THEN least(0.5 / f, 10) ELSE least(0.5 / (1 - f), 10) END AS wm FROM (SELECT *, avg(t) OVER () AS f FROM (SELECT val, CASE WHEN gt > 0 THEN 1.0 ELSE 0 END AS t FROM v))"


@query(with_v1(composite_sql(BALANCED, CFG, "loss_aff"), VOLUMES, O, NEAR, H))
def affinity_loss(spark, d):
    return r6(L.affinity_loss(head(spark, d), CFG), "loss_aff")


@query(with_v1("SELECT off, t, round(any_value(CASE WHEN t > 0.5 THEN least(0.5 / f, 10) ELSE least(0.5 / (1 - f), 10) END), 6) AS cw FROM (SELECT off, t, sum(t * valid) OVER (PARTITION BY off) / sum(valid) OVER (PARTITION BY off) AS f FROM hd) GROUP BY off, t", VOLUMES, O, NEAR, H))
def class_balance(spark, d):
    cfg = L.LossConfig(n_pull=N_PULL)
    rows = L.class_balance(L.affinity_rows(head(spark, d), cfg), "auto", ["off"])
    return rows.groupBy("off", "t").agg(F.round(F.max("cw"), 6).alias("cw"))


@query(with_v1(composite_sql(SEM, CFG, "loss_sem")))
def sem_loss(spark, d):
    h = gt(spark, d).withColumn("sem", F.col("val") * 10)
    return r6(L.sem_loss(h, CFG), "loss_sem")


@query(with_v1("SELECT round(avg(abs(d_)), 6) AS l1, round(avg(d_ * d_), 6) AS mse, round(avg(CASE WHEN abs(d_) < 1 THEN 0.5 * d_ * d_ ELSE abs(d_) - 0.5 END), 6) AS smooth FROM (SELECT val * 8 - (val * 0.5 + 0.1) AS d_ FROM v)"))
def raw_loss(spark, d):
    h = v1(spark, d).select((F.col("val") * 8).alias("raw"), (F.col("val") * 0.5 + 0.1).alias("image"))
    one = lambda name, alias: L.raw_loss(h, name).select(F.round("loss_raw", 6).alias(alias))
    return one("l1", "l1").crossJoin(one("mse", "mse")).crossJoin(one("huber", "smooth"))


@query(with_v1("SELECT z, y, x, round(-(t * ln(p) + (1 - t) * ln(1 - p)), 6) AS bce FROM (SELECT z, y, x, CASE WHEN gt > 0 THEN 1.0 ELSE 0 END AS t, least(greatest(val + 0.2, 1e-7), 1 - 1e-7) AS p FROM v)"))
def bce_on_probs(spark, d):
    return v1(spark, d).select("z", "y", "x", F.round(L.bce_on_probs(F.col("val") + 0.2, (F.col("gt") > 0).cast("double")), 6).alias("bce"))


@query(with_v1(f"SELECT loss_aff, loss_sem, loss_raw, round(a0 + s0 + 0.25 * r0, 4) AS loss FROM (SELECT round(a, 6) AS loss_aff, round(s, 6) AS loss_sem, round(r, 6) AS loss_raw, a AS a0, s AS s0, r AS r0 FROM ({composite_sql(BALANCED, CFG, 'a')}), ({composite_sql(SEM, CFG, 's')}), (SELECT avg(abs(val - (val * 0.5 + 0.1))) AS r FROM v))", VOLUMES, O, NEAR, H))
def total_loss(spark, d):
    out = L.total_loss(head(spark, d), CFG)
    return r6(out, "loss_aff", "loss_sem", "loss_raw").withColumn("loss", F.round("loss", 4))


@query(with_v1("SELECT volume, z, y, x, val, gt FROM v"))
def write_volume(spark, d):
    """Voxels written as blocks and read back."""
    return S.round_trip_blocks(v1(spark, d), ["val", "gt"], block=BLOCK)


@query(with_v1("SELECT z, y, x, val FROM v"))
def ingest_volume(spark, d):
    """Sections written as array files and read back by byte ranges."""
    return S.round_trip_arrays(v1(spark, d), "val").select("z", "y", "x", "val")
