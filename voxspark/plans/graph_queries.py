"""Queries over graphs of voxels whose SQL walks step by step: components, growth, Mutex Watershed, reports."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import blend as B, evaluate as E, graph as G, metrics as M, mutex as X
from ..scratch import Scratch
from .fixtures import VOLUMES, v1, volumes_of, with_v1
from .registry import ORACLES, query
from .segmentation_queries import AMI, ARI, BLOCK, H, N_PULL, NEAR, O, OFFSETS, head, sums_sql
from .volume_queries import r6


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def components_sql(value: str, min_voxels: int) -> str:
    """Six-neighbour components of equal values above 0, numbered by first voxel; smaller ones become 0."""
    return recursive(with_v1(
        f"SELECT z, y, x, CASE WHEN value > 0 AND n >= {min_voxels} THEN r ELSE 0 END AS component FROM fg LEFT JOIN cc ON node = id "
        "LEFT JOIN (SELECT root, count(*) AS n, row_number() OVER (ORDER BY root) AS r FROM cc GROUP BY root) USING (root)",
        f"fg AS (SELECT (z * 50 + y) * 64 + x AS id, z, y, x, {value} AS value FROM v)",
        "s(dz, dy, dx) AS (VALUES (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1), (-1, 0, 0), (1, 0, 0))",
        "nb AS (SELECT f.id AS a, g.id AS b FROM fg f CROSS JOIN s JOIN fg g ON g.z = f.z + dz AND g.y = f.y + dy AND g.x = f.x + dx AND g.value = f.value WHERE f.value > 0)",
        # each voxel takes the least of its neighbours' roots and its root's root
        "cc(node, root) USING KEY (node) AS (SELECT id, id FROM fg WHERE value > 0 UNION SELECT node, min(low) FROM (SELECT r.node, r.root, least(b.root, rr.root) AS low "
        "FROM recurring.cc AS r JOIN nb ON nb.a = r.node JOIN recurring.cc AS b ON b.node = nb.b JOIN recurring.cc AS rr ON rr.node = r.root WHERE EXISTS (SELECT 1 FROM cc)) WHERE low < root GROUP BY node)",
    ))


ORACLES["label_components"] = components_sql("gt", 50)
ORACLES["label_binary"] = components_sql("CASE WHEN val > 0.05 THEN 1 ELSE 0 END", 0)


@query(with_v1("SELECT v.z, v.y, v.x, CASE WHEN v.val > 0.3 THEN any_value(v.gt) ELSE arg_min(sd.gt, (4 * (v.z - sd.z) ** 2 + (v.y - sd.y) ** 2 + (v.x - sd.x) ** 2) * 100000000 + sd.z * 10000 + sd.y * 100 + sd.x) END AS gt FROM v, sd GROUP BY v.z, v.y, v.x, v.val", "sd AS (SELECT z, y, x, gt FROM v WHERE val > 0.3)"))
def grow_labels_unlimited(spark, d):
    """All background takes the nearest of a few labelled voxels."""
    seeds = v1(spark, d).withColumn("gt", F.when(F.col("val") > 0.3, F.col("gt")).otherwise(0))
    return G.grow_labels(seeds, "gt", 0, (2.0, 1.0, 1.0), block=BLOCK).select("z", "y", "x", "gt")


def window_sql(axis: str, size: str) -> str:
    return f"w{axis} AS (SELECT DISTINCT unnest(list_append(list_transform(range(0, greatest(1, ({size} - 8 + 4) // 4)), lambda i: least(i * 4, {size} - 8)), {size} - 8)) AS w{axis} FROM vol)"


WEIGHTED = "SELECT CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(sum(val * wt) / (sum(wt) + 1e-8), 6) AS val FROM (SELECT *, exp(-((z - wz - {c}) ** 2 + (y - wy - {c}) ** 2 + (x - wx - {c}) ** 2) / (2 * {s} ** 2)) AS wt FROM sc) GROUP BY z, y, x"


def _by_place(pdf):
    """A model that adds a tenth of the window's place to the value."""
    return pdf.assign(val=pdf["val"] + (pdf["wz"] + 2 * pdf["wy"] + 3 * pdf["wx"]) / 10)


@query(with_v1(WEIGHTED.format(c=4, s=1.0), VOLUMES, window_sql("z", "d"), window_sql("y", "h"), window_sql("x", "w"),
    "sc AS (SELECT v.z, v.y, v.x, wz, wy, wx, val + (wz + 2 * wy + 3 * wx) / 10 AS val FROM v JOIN wz ON z >= wz AND z < wz + 8 JOIN wy ON y >= wy AND y < wy + 8 JOIN wx ON x >= wx AND x < wx + 8)"))
def blend_patches(spark, d):
    v = v1(spark, d)
    return r6(B.slide(v, volumes_of(v), "val", _by_place, (8, 8, 8), (4, 4, 4), grid="cover"), "val").select("z", "y", "x", "val")


def _with_mean(pdf):
    """A model that sees its whole window: the value plus the window's mean."""
    return pdf.assign(val=pdf["val"] + pdf["val"].mean())


def padded_sql(axis: str, size: str) -> str:
    """Places of an axis in whole strides of six for windows of twelve, with the place that each mirrors."""
    return (
        f"p{axis} AS (SELECT i AS p{axis}, CASE WHEN i % (2 * ({size} - 1)) < {size} THEN i % (2 * ({size} - 1)) ELSE 2 * ({size} - 1) - i % (2 * ({size} - 1)) END AS s{axis} FROM (SELECT {size}, unnest(range(0, CAST(ceil(greatest({size} - 12, 0) / 6) * 6 + 12 AS BIGINT))) AS i FROM vol)),"
        f" w{axis} AS (SELECT unnest(range(0, CAST(ceil(greatest({size} - 12, 0) / 6) * 6 + 1 AS BIGINT), 6)) AS w{axis} FROM vol)"
    )


@query(with_v1(WEIGHTED.format(c=6, s=1.5).replace("FROM sc)", "FROM sc, vol WHERE z < d AND y < h AND x < w)"), VOLUMES, padded_sql("z", "d"), padded_sql("y", "h"), padded_sql("x", "w"),
    "pv AS (SELECT pz AS z, py AS y, px AS x, val FROM pz CROSS JOIN py CROSS JOIN px JOIN v ON v.z = sz AND v.y = sy AND v.x = sx)",
    "sc AS (SELECT pv.z, pv.y, pv.x, wz, wy, wx, val + avg(val) OVER (PARTITION BY wz, wy, wx) AS val FROM pv JOIN wz ON z >= wz AND z < wz + 12 JOIN wy ON y >= wy AND y < wy + 12 JOIN wx ON x >= wx AND x < wx + 12)"))
def blend_reflected(spark, d):
    """Windows over a volume mirrored at its far faces: an axis shorter than the window, and last strides that go beyond."""
    v = v1(spark, d)
    return r6(B.slide(v, volumes_of(v), "val", _with_mean, (12, 12, 12), (6, 6, 6)), "val").select("z", "y", "x", "val")


def crops_of(df):
    """Crops of two sections of about ten by sixteen voxels, across the borders of the true objects."""
    out = df.withColumn("sample_id", (F.floor(F.col("z") / 2) * 100 + F.floor((F.col("y") + 5) / 10) * 10 + F.floor((F.col("x") + 8) / 16)).cast("long"))
    out = out.withColumns({f"from_{a}": F.min(a).over(Window.partitionBy("sample_id")) for a in "zyx"})  # the crops' tasks need the same shuffle
    return out.withColumns({a: (F.col(a) - F.col(f"from_{a}")).cast("int") for a in "zyx"})


#: A crop's number and its place in the volume.
PLACED = ["sample_id", "from_z", "from_y", "from_x"]


CROP = """hs AS (SELECT *, CAST(z // 2 * 100 + (y + 5) // 10 * 10 + (x + 8) // 16 AS BIGINT) AS s FROM hd),
hc AS (SELECT *, min(z) OVER (PARTITION BY s) AS z0, min(y) OVER (PARTITION BY s) AS y0, min(x) OVER (PARTITION BY s) AS x0, max(z) OVER (PARTITION BY s) AS z1, max(y) OVER (PARTITION BY s) AS y1, max(x) OVER (PARTITION BY s) AS x1 FROM hs),
nd AS (SELECT DISTINCT s, z, y, x, gt, val, ((z - z0) * (y1 - y0 + 1) + y - y0) * (x1 - x0 + 1) + x - x0 + 1 AS node FROM hc)"""


# one edge a step: `lab` holds each voxel's smallest clustermate, `bans` the pairs that may not meet
ONE_BY_ONE = """st(s, i, lab, bans) USING KEY (s) AS (
  SELECT s, CAST(0 AS BIGINT), range(1, max(node) + 1), CAST([] AS BIGINT[]) FROM nd GROUP BY s
  UNION
  SELECT s, i + 1,
    CASE WHEN a <> b AND NOT push AND NOT list_contains(bans, a * 1000 + b) THEN list_transform(lab, lambda q: CASE WHEN q = b THEN a ELSE q END) ELSE lab END,
    CASE WHEN a = b THEN bans WHEN push THEN list_append(bans, a * 1000 + b) WHEN list_contains(bans, a * 1000 + b) THEN bans
      ELSE list_transform(bans, lambda q: least(CASE WHEN q // 1000 = b THEN a ELSE q // 1000 END, CASE WHEN q % 1000 = b THEN a ELSE q % 1000 END) * 1000 + greatest(CASE WHEN q // 1000 = b THEN a ELSE q // 1000 END, CASE WHEN q % 1000 = b THEN a ELSE q % 1000 END)) END
  FROM (SELECT st.s, st.i, lab, bans, push, least(lab[u], lab[v]) AS a, greatest(lab[u], lab[v]) AS b FROM st JOIN ce ON ce.s = st.s AND ce.i = st.i + 1)
),"""


def rounds_sql(buckets: int) -> str:
    """A round of a bucket a step: `es` its edges between clusters, `cand` those that may join, `p0` where each cluster goes, `p9` where that leads."""
    jumps = "(SELECT *, list_transform(range(1, len(lab) + 1), lambda q: coalesce(cand[list_position(higher, q)].a, q)) AS p0 FROM cd)"
    for n in range(9):  # chains of up to 2 ** 9 joins
        jumps = f"(SELECT * EXCLUDE (p{n}), list_transform(p{n}, lambda q: p{n}[q]) AS p{n + 1} FROM {jumps})"
    return f"""eb AS (SELECT s, (i * {buckets} - 1) // count(*) OVER (PARTITION BY s) AS k, i, u, v, push FROM ce),
el AS (SELECT s, k, list({{'u': u, 'v': v, 'push': push}} ORDER BY i) AS es FROM eb GROUP BY s, k),
st(s, k, lab, bans) USING KEY (s) AS (
  SELECT s, CAST(0 AS BIGINT), range(1, max(node) + 1), CAST([] AS BIGINT[]) FROM nd GROUP BY s
  UNION
  (WITH es AS (SELECT st.s, st.k, lab, bans, list_filter(list_transform(coalesce(es, []), lambda e: {{'a': least(lab[e.u], lab[e.v]), 'b': greatest(lab[e.u], lab[e.v]), 'push': e.push}}), lambda e: e.a <> e.b) AS es
    FROM st LEFT JOIN el ON el.s = st.s AND el.k = st.k WHERE st.k < {buckets}),
  bn AS (SELECT s, k, lab, es, list_distinct(list_concat(bans, list_transform(list_filter(es, lambda e: e.push), lambda e: e.a * 1000 + e.b))) AS bans FROM es),
  ca AS (SELECT s, k, lab, bans, list_filter(es, lambda e: NOT e.push AND NOT list_contains(bans, e.a * 1000 + e.b)) AS cand FROM bn),
  cd AS (SELECT *, list_transform(cand, lambda e: e.b) AS higher FROM ca)
  SELECT s, CASE WHEN len(cand) = 0 THEN k + 1 ELSE k END, list_transform(lab, lambda q: p9[q]),
    list_distinct(list_transform(bans, lambda q: least(p9[q // 1000], p9[q % 1000]) * 1000 + greatest(p9[q // 1000], p9[q % 1000]))) FROM {jumps})
),"""


def watershed_sql(mask: str, most_push: int | None, min_size: int, steps: str = ONE_BY_ONE) -> str:
    """Mutex Watershed of each crop."""
    cap = f"WHERE NOT push OR rp <= {most_push}" if most_push is not None else ""
    return f"""{CROP},
ee AS (SELECT h.s, a.node AS u, b.node AS v, h.off, h.off >= {N_PULL} AS push, CAST(CASE WHEN h.off < {N_PULL} THEN CAST(prob AS FLOAT) ELSE CAST(1 AS FLOAT) - CAST(prob AS FLOAT) END AS DOUBLE) AS w
FROM hc h JOIN o USING (off) JOIN nd a ON a.s = h.s AND a.z = h.z AND a.y = h.y AND a.x = h.x JOIN nd b ON b.s = h.s AND b.z = h.z + dz AND b.y = h.y + dy AND b.x = h.x + dx
WHERE ({mask.format("a")}) AND ({mask.format("b")}) AND (h.off < {N_PULL} OR ((h.y - y0 - greatest(0, -dy)) % 2 = 0 AND (h.x - x0 - greatest(0, -dx)) % 2 = 0))),
ec AS (SELECT *, row_number() OVER (PARTITION BY s, push ORDER BY w DESC, off, u) AS rp FROM ee),
ce AS (SELECT s, u, v, push, row_number() OVER (PARTITION BY s ORDER BY w DESC, off, u) AS i FROM ec {cap}),
{steps}
rt AS (SELECT nd.*, lab[node] AS root FROM nd JOIN st USING (s) WHERE {mask.format("nd")}),
rs AS (SELECT s, root, count(*) AS n, count(*) >= {min_size} AS stays FROM rt GROUP BY s, root),
rk AS (SELECT *, CASE WHEN stays THEN sum(CASE WHEN stays THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY root) ELSE 0 END AS label FROM rs),
sg AS (SELECT nd.s, nd.z, nd.y, nd.x, nd.gt, CAST(coalesce(rk.label, 0) AS BIGINT) AS label FROM nd LEFT JOIN rt ON rt.s = nd.s AND rt.node = nd.node LEFT JOIN rk ON rk.s = rt.s AND rk.root = rt.root)"""


CROPPED = "SELECT s AS sample_id, z, y, x, label FROM sg"


def _whole(out):
    """Voxels of crops at their places in the volume."""
    return out.select("sample_id", *((F.col(a) + F.col(f"from_{a}")).alias(a) for a in "zyx"), "label")


@query(recursive(with_v1(CROPPED, VOLUMES, O, NEAR, H, watershed_sql("true", None, 0))))
def mutex_watershed_crops(spark, d):
    """The exact Mutex Watershed of many small crops."""
    h = crops_of(head(spark, d))
    return _whole(G.agglomerate(h, OFFSETS, N_PULL, "prob", strides=(1, 2, 2), by=PLACED))


@query(recursive(with_v1(CROPPED, VOLUMES, O, NEAR, H, watershed_sql("true", None, 0, rounds_sql(16)))))
def mutex_watershed_bucketed(spark, d):
    """The Mutex Watershed of many small crops in sixteen buckets of edges."""
    h = crops_of(head(spark, d))
    return _whole(G.agglomerate(h, OFFSETS, N_PULL, "prob", strides=(1, 2, 2), by=PLACED, method="bucketed"))


@query(f"""WITH xa AS ({ORACLES["mutex_watershed_crops"]}), xb AS ({ORACLES["mutex_watershed_bucketed"]}),
{sums_sql("SELECT sample_id, xa.label AS true_, xb.label AS pred FROM xa JOIN xb USING (sample_id, z, y, x)", "sample_id")}
SELECT s AS sample_id, round(CASE WHEN sqa = sq AND sqb = sq THEN 1 ELSE {ARI} END, 6) AS ari FROM m""")
def mutex_bucketed_ari(spark, d):
    """How far the bucketed method agrees with the exact one, crop by crop."""
    h = crops_of(head(spark, d))
    exact = G.agglomerate(h, OFFSETS, N_PULL, "prob", strides=(1, 2, 2), by=["sample_id"], carry=["prob"]).withColumnRenamed("label", "true")
    both = G.agglomerate(exact, OFFSETS, N_PULL, "prob", strides=(1, 2, 2), by=["sample_id"], method="bucketed", carry=["true"]).withColumnRenamed("label", "pred")
    labels = Scratch(spark, "agreement").keep(both.select("sample_id", "true", "pred"))  # the index reads them more than once
    return r6(M.ari(labels, ["sample_id"]), "ari")


@query(recursive(with_v1(CROPPED, VOLUMES, O, NEAR, H, watershed_sql("{0}.val > 0", 12, 4))))
def agglomerate_crops(spark, d):
    """Crops within a mask, with the 12 heaviest push edges each, without small objects."""
    h = crops_of(head(spark, d)).withColumn("fg", F.col("sem") > 0)
    return _whole(G.agglomerate(h, OFFSETS, N_PULL, "prob", "fg", (1, 2, 2), 4, 12, PLACED))


REPORT = sums_sql("SELECT s AS sample_id, gt AS true_, label AS pred FROM sg WHERE gt > 0", "sample_id")


@query(recursive(with_v1(
    f"""SELECT s AS sample_id, metric, round(value, 6) AS value FROM (SELECT s, CASE WHEN sqa = sq AND sqb = sq THEN 1 ELSE {ARI} END AS ari,
CASE WHEN (nt = 1 AND np = 1) OR (nt = cells AND np = cells) THEN 1 ELSE greatest(((ln_ - lna - lnb) / N + ln(N) - emi) / (CASE WHEN (2 * ln(N) - lna / N - lnb / N) / 2 - emi < 0 THEN least((2 * ln(N) - lna / N - lnb / N) / 2 - emi, -2.3e-16) ELSE greatest((2 * ln(N) - lna / N - lnb / N) / 2 - emi, 2.3e-16) END), 0) END AS ami,
(lna + lnb - 2 * ln_) / N / ln(2) AS voi, (lna - ln_) / N / ln(2) AS voi_split, (lnb - ln_) / N / ln(2) AS voi_merge, CAST(2 * cells - nt - np AS DOUBLE) AS ted FROM m JOIN emi USING (s)) UNPIVOT (value FOR metric IN (ari, ami, voi, voi_split, voi_merge, ted))""",
    VOLUMES, O, NEAR, H, watershed_sql("{0}.gt > 0", None, 0), REPORT, AMI)))
def instance_report_affinities(spark, d):
    """The validation metrics straight from affinities: each sample agglomerated inside its true foreground, then compared."""
    h = crops_of(head(spark, d))
    return r6(E.instance_report_of_head(h, OFFSETS, N_PULL, "prob", strides=(1, 2, 2)), "value")


@query()
def mutex_watershed_volume(spark, d):
    """The exact Mutex Watershed of the whole volume, contracted in rounds of cells."""
    return X.agglomerate_volume(head(spark, d), OFFSETS, N_PULL, "prob", strides=(1, 2, 2))
