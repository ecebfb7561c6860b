"""Catalogue, crops and audits of volumes: projections, joins and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import Scratch
from .prefix import running_total

AXES = ("z", "y", "x")
EXTENSIONS = (".h5", ".hdf5", ".tif", ".tiff")


def volume_catalog(specs: DataFrame, files: DataFrame, extensions: Sequence[str] = EXTENSIONS, scratch: Scratch | None = None) -> DataFrame:
    """Resolve specs(vol, seg) against files(base, ext, voxels): the first extension in order wins.

    A spec without an image is skipped, one without a segmentation is image only.
    ``upto`` is the running number of voxels in order of vol.
    """
    rank = F.array_position(F.array(*map(F.lit, extensions)), F.col("ext"))
    known = files.where(rank > 0).groupBy("base").agg(F.min_by(F.struct("ext", "voxels"), F.struct(rank, F.col("voxels"))).alias("f"))
    image = known.select(F.col("base").alias("vol"), F.col("f.ext").alias("image_ext"), F.col("f.voxels").alias("voxels"))
    seg = known.select(F.col("base").alias("seg"), F.col("f.ext").alias("seg_ext"))
    found = specs.join(image, "vol").join(seg, "seg", "left")
    before = running_total(found, ["vol"], "voxels", scratch or Scratch(specs.sparkSession, "catalog"), "_before")
    return before.withColumn("upto", F.col("_before") + F.coalesce("voxels", F.lit(0))).drop("_before")


def in_box(origin: Sequence[int], size: Sequence[int]) -> Column:
    """Voxels of a box; on stored chunks sorted by place the same bounds prune row groups."""
    out = F.lit(True)
    for a, o, s in zip(AXES, origin, size):
        out = out & F.col(a).between(o, o + s - 1)
    return out


def read_box(voxels: DataFrame, origin: Sequence[int], size: Sequence[int], rebase: bool = True) -> DataFrame:
    cut = voxels.where(in_box(origin, size))
    return cut.withColumns({a: F.col(a) - o for a, o in zip(AXES, origin)}) if rebase else cut


def crop_boxes(voxels: DataFrame, boxes: DataFrame, cell: int = 16) -> DataFrame:
    """Voxels of many boxes(name, volume, z, y, x, sz, sy, sx), re-based: an equi-join on the lines that a box touches.

    A line is `cell` voxels along x, so that at most a cell at both ends of each line is met in vain, however many boxes there are.
    Both sides are shuffled: a small table of boxes has many lines, which a broadcast would gather in the driver.
    """
    cells = boxes.where("sz > 0 AND sy > 0 AND sx > 0").withColumnsRenamed({a: f"o{a}" for a in AXES})
    for a in ("z", "y"):
        cells = cells.withColumn(f"c{a}", F.explode(F.sequence(F.col(f"o{a}"), F.col(f"o{a}") + F.col(f"s{a}") - 1)))
    cells = cells.withColumn("cx", F.explode(F.sequence(F.floor(F.col("ox") / cell), F.floor((F.col("ox") + F.col("sx") - 1) / cell))))
    at = voxels.withColumns({"cz": F.col("z"), "cy": F.col("y"), "cx": F.floor(F.col("x") / cell)})
    hit = cells.hint("merge").join(at, ["volume", "cz", "cy", "cx"]).where((F.col("x") >= F.col("ox")) & (F.col("x") < F.col("ox") + F.col("sx")))
    rest = [c for c in boxes.columns if c not in ("volume", *AXES, "sz", "sy", "sx")]
    based = {a: F.col(a) - F.col(f"o{a}") for a in AXES}
    return hit.select(*(based[c].alias(c) if c in based else c for c in [*voxels.columns, *rest]))


def volume_meta(voxels: DataFrame, label: str | None = None) -> DataFrame:
    labels = [F.count_distinct(label).alias("n_labels"), (F.max(label) > 0).alias("has_seg")] if label else []
    return voxels.groupBy("volume").agg((F.max("z") + 1).alias("d"), (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.count("*").alias("voxels"), *labels)


def spacing_from_directions(df: DataFrame, directions: str, spacings: str | None = None) -> DataFrame:
    """Voxel spacing: the length of each direction vector, null vectors dropped; else explicit spacings."""
    kept = F.filter(directions, lambda d: d.isNotNull())
    length = F.transform(kept, lambda d: F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)))
    return df.withColumn("spacing", F.coalesce(length, F.col(spacings)) if spacings else length)


def clamp_box(requests: DataFrame, bounds: DataFrame) -> DataFrame:
    """Boxes cut to bounds(volume, d, h, w); a null origin is centred."""
    df = requests.join(bounds, "volume")
    for a, n in zip(AXES, ("d", "h", "w")):
        size = F.least(F.col(f"s{a}"), F.col(n))
        origin = F.coalesce(F.col(a), F.floor((F.col(n) - size) / 2).cast("int"))
        df = df.withColumns({f"s{a}": size, a: F.least(F.greatest(origin, F.lit(0)), F.col(n) - size)})
    return df.drop("d", "h", "w")


def map_no_data(voxels: DataFrame, marker: int, label: str) -> DataFrame:
    """Labels with the marker become 0; image_only marks volumes without any label."""
    df = voxels.withColumn(label, F.when(F.col(label) == marker, 0).otherwise(F.col(label)))
    some = df.groupBy("volume").agg((~F.bool_or(F.col(label) > 0)).alias("image_only"))
    return df.join(some, "volume")


ORIENTATIONS = {"z": ("z", "y", "x"), "y": ("y", "z", "x"), "x": ("x", "y", "z")}


def permute_axes(voxels: DataFrame, orientation: str, isotropic: bool = True) -> DataFrame:
    """Re-orient: the named axis becomes the section axis; only isotropic volumes may leave z."""
    if orientation not in ORIENTATIONS:
        raise ValueError(f"unknown orientation {orientation!r}")
    if orientation != "z" and not isotropic:
        raise ValueError("only isotropic volumes can be re-oriented")
    return voxels.withColumns({to: F.col(a) for to, a in zip(AXES, ORIENTATIONS[orientation])})


def zstride_phases(voxels: DataFrame, stride: int) -> DataFrame:
    """Every stride-th section, for all phases: each row falls in one."""
    return voxels.withColumns({"phase": F.pmod("z", F.lit(stride)), "z": F.floor(F.col("z") / stride).cast("int")})


def coverage_stats(voxels: DataFrame, label: str, warn_below: float = 0.05) -> DataFrame:
    share = F.avg((F.col(label) > 0).cast("int"))
    return voxels.groupBy("volume").agg(F.count_distinct(label).alias("n_ids"), share.alias("foreground")).withColumn("sparse", F.col("foreground") < warn_below)


def crop_size_estimate(crops: DataFrame, seg_versions: int = 1) -> DataFrame:
    """GB of image (1 byte a voxel) and segmentation (8 bytes a voxel and version) of all crops."""
    n = (F.col("sz").cast("double") * F.col("sy") * F.col("sx")) / 1e9
    return crops.agg(F.sum(n).alias("image_gb"), F.sum(n * 8 * seg_versions).alias("seg_gb"), F.sum(n * (1 + 8 * seg_versions)).alias("total_gb"))


def crop_name(crops: DataFrame, prefix: str, mip: int = 0, kind: str = "image", version: int = 0) -> DataFrame:
    tail = f"_v{version}_{kind}" if version else f"_{kind}"
    return crops.withColumn("crop_name", F.format_string(f"{prefix}_mip{mip}_%dx%dx%d_x%d_y%d_z%d{tail}", "sx", "sy", "sz", "x", "y", "z"))


def parse_crop_name(df: DataFrame, column: str) -> DataFrame:
    part = lambda a: F.regexp_extract(column, rf"x(-?\d+)_y(-?\d+)_z(-?\d+)", "xyz".index(a) + 1).cast("int")  # noqa: E731, F541
    return df.withColumns({f"p{a}": part(a) for a in "xyz"})


def split_assign(volumes: DataFrame, splits: DataFrame) -> DataFrame:
    """The split of each volume from splits(split, volume); without validation volumes those of train serve, without test those given as such."""
    named = volumes.join(splits, "volume")
    out = named
    have = splits.agg(F.count_if(F.col("split") == "val").alias("v"), F.count_if(F.col("split") == "test").alias("t"))
    for split, other, flag in (("val", "train", "v"), ("test", "train", "t")):
        extra = named.where(F.col("split") == other).crossJoin(F.broadcast(have)).where(F.col(flag) == 0).drop("v", "t").withColumn("split", F.lit(split))
        out = out.unionByName(extra)
    return out


def split_overlaps(boxes: DataFrame, cell: int | Sequence[int] | None = None, per_task: int = 50_000) -> DataFrame:
    """Pairs of boxes(name, z, y, x, sz, sy, sx) that overlap: met on common cells, tested exactly.

    Without `cell` cells are as long as boxes are on average, but no box touches more than 17 of them along an axis.
    The boxes of a cell with over `per_task` are dealt to parts of about that many, and each two parts meet in a group of their
    own; a box moves once for each part that its own meets, so parts are large.  Both sides are shuffled: few boxes have many
    pairs, which a broadcast of one side would leave to the tasks that read the other.
    """
    if cell is None:
        sides = [F.col(f"s{a}") for a in AXES]
        found = boxes.agg(*(F.greatest(F.ceil(F.avg(s)), F.ceil(F.max(s) / 16), F.lit(1)).cast("long") for s in sides)).first()  # one row
        cell = [int(c or 1) for c in found]
    each = dict(zip(AXES, [cell] * 3 if isinstance(cell, int) else cell))
    places = [f"c{a}" for a in AXES]
    cells = boxes
    for a in AXES:
        cells = cells.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(a) / each[a]), F.floor((F.col(a) + F.col(f"s{a}") - 1) / each[a]))))
    crowded = cells.groupBy(*places).agg(F.ceil(F.count("*") / per_task).cast("int").alias("_n")).where("_n > 1")  # one row for per_task rows at most
    dealt = cells.join(F.broadcast(crowded), places, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    dealt = dealt.withColumn("_p", F.pmod(F.xxhash64("name", *AXES), F.col("_n")).cast("int"))
    a_ = dealt.withColumn("_q", F.explode(F.sequence("_p", F.col("_n") - 1))).drop("_n").alias("a").hint("merge")
    b_ = dealt.withColumnRenamed("_p", "_q").withColumn("_p", F.explode(F.sequence(F.lit(0), "_q"))).drop("_n").alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*places, "_p", "_q")]
    over = [(F.col(f"a.{a}") < F.col(f"b.{a}") + F.col(f"b.s{a}")) & (F.col(f"b.{a}") < F.col(f"a.{a}") + F.col(f"a.s{a}")) for a in AXES]
    # the cell with the smallest coordinates that both have counts a pair once
    once = [F.col(f"a.c{a}") == F.floor(F.greatest(F.col(f"a.{a}"), F.col(f"b.{a}")) / each[a]) for a in AXES]
    # within a part each pair meets in both orders, two parts meet in one
    order = (F.col("a.name") < F.col("b.name")) | ((F.col("a._p") < F.col("a._q")) & (F.col("a.name") != F.col("b.name")))
    return a_.join(b_, [*same, *over, *once, order]).select(F.least("a.name", "b.name").alias("left"), F.greatest("a.name", "b.name").alias("right"))


def checksum_audit(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files(name, size, md5) against manifest(name, size, md5): ok, mismatch or missing; a null on one side only is a mismatch."""
    got = files.select("name", F.col("size").alias("got_size"), F.col("md5").alias("got_md5"), F.lit(True).alias("there"))
    same = F.col("size").eqNullSafe(F.col("got_size")) & F.col("md5").eqNullSafe(F.col("got_md5"))
    status = F.when(F.col("there").isNull(), "missing").when(~same, "mismatch").otherwise("ok")
    return manifest.join(got, "name", "left").select("name", status.alias("status"))
