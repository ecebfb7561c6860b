"""Augmentations as coordinate projections and joins, fixed by (seed, sample)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import Scratch
from .graph import label_components
from .neighbors import boundaries
from .prefix import consecutive
from .tiling import AXES, SIZES, below, foreground_crop, random_start, uniform
from .zoom import zoom_samples


def flip(df: DataFrame, axes: Sequence[str], when: Column | None = None) -> DataFrame:
    """Mirror along axes, using the sizes d, h, w."""
    on = F.lit(True) if when is None else when
    return df.withColumns({a: F.when(on, F.col(n) - 1 - F.col(a)).otherwise(F.col(a)) for a, n in zip(AXES, SIZES) if a in axes})


def rand_flip(df: DataFrame, seed: int, prob: float = 0.5, by: str = "sample_id") -> DataFrame:
    for k, a in enumerate(AXES):
        df = flip(df, [a], uniform(F.lit(seed), F.lit(k), by) < prob)
    return df


def rot90(df: DataFrame, k: int | Column) -> DataFrame:
    """Turn by k quarter turns in (y, x), counter-clockwise; square or not, sizes follow."""
    k = F.pmod(F.lit(k) if isinstance(k, int) else k, F.lit(4))
    y, x, h, w = (F.col(c) for c in ("y", "x", "h", "w"))
    pick = lambda *v: F.when(k == 0, v[0]).when(k == 1, v[1]).when(k == 2, v[2]).otherwise(v[3])
    return df.withColumns({"y": pick(y, w - 1 - x, h - 1 - y, x), "x": pick(x, y, w - 1 - x, h - 1 - y), "h": pick(h, w, h, w), "w": pick(w, h, w, h)})


def transpose_xy(df: DataFrame, when: Column | None = None) -> DataFrame:
    on = F.lit(True) if when is None else when
    return df.withColumns({a: F.when(on, F.col(b)).otherwise(F.col(a)) for a, b in (("y", "x"), ("x", "y"), ("h", "w"), ("w", "h"))})


def rand_rot90(df: DataFrame, seed: int, prob: float = 0.5, by: str = "sample_id") -> DataFrame:
    """One to three quarter turns in a share of the samples."""
    turns = 1 + below(F.lit(3), F.lit(seed), F.lit("turns"), by)
    return rot90(df, F.when(uniform(F.lit(seed), F.lit("rot"), by) < prob, turns).otherwise(0))


def rand_transpose_xy(df: DataFrame, seed: int, prob: float = 0.5, by: str = "sample_id") -> DataFrame:
    return transpose_xy(df, uniform(F.lit(seed), F.lit("transpose"), by) < prob)


def random_drops(samples: DataFrame, seed: int, most: int, prob: float = 1.0, consecutive: bool = False) -> DataFrame:
    """Sections (sample_id, z) to drop: 1 to most of d, scattered or in a run; of samples(sample_id, d) at least one stays.

    samples(sample_id, d, z) hold the sections that are there, of which scattered ones are chosen.
    """
    k = F.least(below(F.lit(most), F.lit(seed), F.lit("k"), "sample_id") + 1, F.col("d") - 1)
    df = samples.where((F.col("d") > 1) & (uniform(F.lit(seed), F.lit("p"), "sample_id") < prob)).withColumn("k", k)
    if consecutive:
        df = df.select("sample_id", "d", "k").distinct()
        start = below(F.col("d") - F.col("k") + 1, F.lit(seed), F.lit("start"), "sample_id")
        return df.select("sample_id", F.explode(F.sequence(start, start + F.col("k") - 1)).alias("z"))
    z = df if "z" in df.columns else df.withColumn("z", F.explode(F.sequence(F.lit(0), F.col("d") - 1)))
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy(uniform(F.lit(seed), F.lit("drop"), "sample_id", "z"), "z"))
    return z.withColumn("_r", rank).where("_r <= k").select("sample_id", "z")


def missing_section(df: DataFrame, drops: DataFrame, value: str, fill: str = "zero", by: str = "sample_id") -> DataFrame:
    """Fill dropped sections by zero, the sample's mean, or the nearest section that stays (ties: the lower)."""
    marked = df.join(drops.select(by, "z").distinct().withColumn("_drop", F.lit(True)), [by, "z"], "left")
    gone = F.col("_drop").isNotNull()
    if fill == "zero":
        return marked.withColumn(value, F.when(gone, 0).otherwise(F.col(value)).cast(df.schema[value].dataType)).drop("_drop")
    if fill == "mean":
        mean = df.groupBy(by).agg(F.avg(value).alias("_mean"))
        return marked.join(mean, by).withColumn(value, F.when(gone, F.col("_mean")).otherwise(F.col(value))).drop("_drop", "_mean")
    if fill != "nearest":
        raise ValueError(f"unknown fill {fill!r}")
    sections = df.select(by, "z").distinct().join(drops.select(by, "z").distinct().withColumn("_drop", F.lit(True)), [by, "z"], "left")
    kept = sections.where("_drop IS NULL").groupBy(by).agg(F.array_sort(F.collect_list("z")).alias("_kept"))  # one number a section
    near = sections.where("_drop IS NOT NULL").join(kept, by).withColumn("_near", F.array_min(F.transform("_kept", lambda k: F.struct(F.abs(k - F.col("z")).alias("far"), k.alias("k"))))["k"])
    source = df.select(by, F.col("z").alias("_near"), "y", "x", F.col(value).alias("_new"))
    filled = df.join(near.select(by, "z", "_near"), [by, "z"]).join(source, [by, "_near", "y", "x"]).withColumn(value, F.col("_new")).select(df.columns)
    return marked.where(~gone).select(df.columns).unionByName(filled)


def gamma_contrast(df: DataFrame, value: str, gamma: float | Column, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """((v - min) / range) ** gamma * range + min."""
    g = F.lit(gamma) if isinstance(gamma, (int, float)) else gamma
    r = df.groupBy(*by).agg(F.min(value).alias("_lo"), (F.max(value) - F.min(value)).alias("_r"))
    v = F.pow((F.col(value) - F.col("_lo")) / (F.col("_r") + 1e-7), g) * F.col("_r") + F.col("_lo")
    return df.join(r, list(by)).withColumn(value, v).drop("_lo", "_r")


def gaussian_noise(df: DataFrame, value: str, std: float | Column, seed: int, keys: Sequence[str], when: Column | None = None) -> DataFrame:
    """Noise by Box-Muller from hashed keys: the same however the rows are dealt out."""
    u, v = uniform(F.lit(seed), F.lit(1), *keys), uniform(F.lit(seed), F.lit(2), *keys)
    noisy = F.col(value) + std * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * 3.141592653589793 * v)
    return df.withColumn(value, noisy if when is None else F.when(when, noisy).otherwise(F.col(value)))


def rand_contrast(df: DataFrame, value: str, seed: int, gamma: Sequence[float] = (0.7, 1.3), prob: float = 0.5, by: str = "sample_id") -> DataFrame:
    """Contrast by a random gamma in a share of the samples."""
    g = gamma[0] + (gamma[1] - gamma[0]) * uniform(F.lit(seed), F.lit("gamma"), by)
    out = gamma_contrast(df.withColumn("_as_it_was", F.col(value)), value, g, [by])
    on = uniform(F.lit(seed), F.lit("contrast"), by) < prob
    return out.withColumn(value, F.when(on, F.col(value)).otherwise(F.col("_as_it_was"))).drop("_as_it_was")


def rand_noise(df: DataFrame, value: str, seed: int, most: float = 0.05, prob: float = 0.5, by: str = "sample_id") -> DataFrame:
    """Noise in a share of the samples, of a standard deviation drawn up to `most` for each."""
    std = most * uniform(F.lit(seed), F.lit("std"), by)
    return gaussian_noise(df, value, std, seed, [by, *AXES], uniform(F.lit(seed), F.lit("noise"), by) < prob)


def zoom_factors(samples: DataFrame, target: Sequence[float] | Sequence[Sequence[float]], mode: str = "ratio", u: Sequence[Column] | None = None, seed: int = 0, skip_isotropic: bool = True) -> DataFrame:
    """zoom = native / target resolution, from native rz, ry, rx and uniform draws.

    target: the range of resolutions, one for all axes or one each for z, y and x;
    ratio: one target for y, the others by their native ratio, clipped to the range;
    union: log-uniform targets for z and for (y, x); isotropic volumes stay.
    """
    ranges = [tuple(map(float, t)) for t in target] if isinstance(target[0], Sequence) else [tuple(map(float, target))] * 3
    lo, hi = ranges[1]
    u = u or [uniform(F.lit(seed), F.lit(k), "sample_id") for k in range(2)]
    z, y, x = F.col("rz"), F.col("ry"), F.col("rx")
    if mode == "ratio":
        ty = lo + (hi - lo) * u[0]
        clip = lambda t, k: F.least(F.greatest(t, F.lit(ranges[k][0])), F.lit(ranges[k][1]))
        targets = {"z": clip(ty * z / y, 0), "y": ty, "x": clip(ty * x / y, 2)}
        return samples.withColumns({f"zoom_{a}": F.col(f"r{a}") / t for a, t in targets.items()})
    log = lambda k: F.exp(F.log(F.lit(ranges[k][0])) + (F.log(F.lit(ranges[k][1])) - F.log(F.lit(ranges[k][0]))) * u[k])
    same = (z == y) & (y == x) if skip_isotropic else F.lit(False)
    targets = {"z": log(0), "y": log(1), "x": log(1)}
    return samples.withColumns({f"zoom_{a}": F.when(same, 1.0).otherwise(F.col(f"r{a}") / t) for a, t in targets.items()})


def resample(df: DataFrame, value: str, zoom: Sequence[float], mode: str = "linear", sizes: Sequence[int] | None = None, by: Sequence[str] = ("volume",)) -> DataFrame:
    """Onto a grid of max(1, round(size * zoom)) (or of given sizes): trilinear with half-voxel centres, or nearest.

    Every source voxel goes to the target voxels that it has a weight in, which follow from its place and the sizes
    alone, and one aggregate adds them up: nothing is joined but the sizes, one row for each of by.
    """
    dims = df.groupBy(*by).agg(*((F.max(a) + 1).alias(n) for a, n in zip(AXES, SIZES)))
    new = [F.lit(sizes[k]) if sizes else F.greatest(F.lit(1), F.rint(F.col(n) * F.lit(zoom[k])).cast("int")) for k, n in enumerate(SIZES)]
    dims = dims.withColumns({f"_n{a}": m for a, m in zip(AXES, new)})
    named = dims.withColumnsRenamed({c: f"_of_{c}" for c in by})
    out = df.select(*by, *(F.col(a).alias(f"_{a}") for a in AXES), F.col(value).alias("_v"))
    out = out.join(named, [out[c] == named[f"_of_{c}"] for c in by]).drop(*(f"_of_{c}" for c in by)) if by else out.crossJoin(F.broadcast(dims))  # one row
    weight = F.lit(1.0)
    for a, n in zip(AXES, SIZES):
        last, scale = F.col(n) - 1, F.col(n) / F.col(f"_n{a}")
        here = F.col(f"_{a}")
        # targets that the voxel may reach; those in between are tested exactly
        first, end = (here / scale, (here + 1) / scale) if mode == "nearest" else ((here - 0.5) / scale - 0.5, (here + 1.5) / scale - 0.5)
        lo, hi = F.greatest(F.floor(first), F.lit(0)).cast("int"), F.least(F.ceil(end), F.col(f"_n{a}") - 1).cast("int")
        if mode == "nearest":
            share = lambda i: F.when(F.least(F.floor(i * scale).cast("int"), last) == here, 1.0).otherwise(0.0)  # noqa: B023, E731
        else:

            def share(i):
                at = F.greatest((i + 0.5) * scale - 0.5, F.lit(0.0))  # noqa: B023
                low = F.least(F.floor(at).cast("int"), last)  # noqa: B023
                up = F.least(low + 1, last)  # noqa: B023
                return F.when(low == here, 1 - (at - low)).otherwise(0.0) + F.when(up == here, at - low).otherwise(0.0)  # noqa: B023

        reached = F.transform(F.when(lo <= hi, F.sequence(lo, hi)), lambda i: F.struct(i.alias("i"), share(i).alias("w")))
        out = out.withColumn(f"_t{a}", F.explode(F.filter(reached, lambda t: t["w"] > 0))).withColumn(a, F.col(f"_t{a}.i"))
        weight = weight * F.col(f"_t{a}.w")
    if mode == "nearest":
        return out.select(*by, *AXES, F.col("_v").alias(value))
    return out.groupBy(*by, *AXES).agg(F.sum(weight * F.col("_v")).alias(value))


def compact_ids(df: DataFrame, column: str, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Ids as their rank among the different ids, from 0, and the table (rank, id) to go back."""
    scratch = scratch or Scratch(df.sparkSession, "compact")
    ranks = consecutive(df.select(F.col(column).alias("_id")).distinct(), "_id", scratch)
    lut = scratch.keep(ranks.select((F.col("rank") - 1).alias("rank"), F.col("_id").alias("id")), "lut")
    out = df.join(lut, df[column] == lut["id"]).withColumn(column, F.col("rank")).select(df.columns)
    return out, lut


def augment_pipeline(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]], scratch: Scratch | None = None) -> DataFrame:
    """The steps one after another; with scratch each result is written, as steps that join read their input several times."""
    for step in steps:
        df = df.transform(step) if scratch is None else scratch.keep(df.transform(step), "step")
    return df


def with_boundaries(df: DataFrame, target: str, label: str = "label", seed: int = 0, prob: float = 1.0) -> DataFrame:
    """Boundaries within sections taken out of the label, or of a copy of it (see sem_label_copy), in a share of the samples."""
    found = boundaries(df.select("sample_id", *AXES, F.col(label).alias("label")), mode="inner", xy_only=True, by=["sample_id"])
    on = F.col("boundary") & (uniform(F.lit(seed), F.lit("boundary"), "sample_id") < prob)
    out = df.join(found.select("sample_id", *AXES, "boundary"), ["sample_id", *AXES])
    return sem_label_copy(out.withColumn("boundary", on), target, label).drop("boundary")


def center_crop(df: DataFrame, size: Sequence[int]) -> DataFrame:
    """Each sample zero-padded to the size and cut to its centre; d, h and w follow."""
    starts = [(F.floor(F.greatest(F.col(n), F.lit(p)) / 2) - p // 2).cast("int") - pad for n, p, pad in zip(SIZES, size, _padding(size))]
    return crop(df, starts, size)


def relabel_parts(df: DataFrame, label: str = "label") -> DataFrame:
    """Connected parts of a sample's labels become labels of their own."""
    parts = label_components(df.select("sample_id", *AXES, label), label, by=["sample_id"])
    return df.drop(label).join(parts.withColumnRenamed("component", label), ["sample_id", *AXES])


#: Columns of a sample that all its voxels share.
RESOLUTION = ("rz", "ry", "rx")


def crop(df: DataFrame, starts: Sequence[Column], size: Sequence[int]) -> DataFrame:
    """The box of this size that begins at `starts` (columns of the sample) in each sample, zero where it leaves the sample; d, h and w follow.

    No voxel moves: those of the box are kept, and what is missing is made from the sample's sizes.
    """
    own = [c for c in RESOLUTION if c in df.columns]
    values = [c for c in df.columns if c not in ("sample_id", *AXES, *SIZES, *own)]
    places = [f"_s{a}" for a in AXES]
    at = df.withColumns(dict(zip(places, starts)))
    inside = at.withColumns({a: (F.col(a) - F.col(s)).cast("int") for a, s in zip(AXES, places)})
    for a, p in zip(AXES, size):
        inside = inside.where((F.col(a) >= 0) & (F.col(a) < p))
    kept = inside.select("sample_id", *AXES, *own, *values)
    short = at.select("sample_id", *SIZES, *own, *places).distinct()
    beyond = F.lit(False)
    for n, s, p in zip(SIZES, places, size):
        beyond = beyond | (F.col(s) < 0) | (F.col(s) + p > F.col(n))
    short = short.where(beyond)
    for a, p in zip(AXES, size):
        short = short.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    out_of = F.lit(False)
    for a, n, s in zip(AXES, SIZES, places):
        out_of = out_of | (F.col(a) + F.col(s) < 0) | (F.col(a) + F.col(s) >= F.col(n))
    empty = short.where(out_of).select("sample_id", *AXES, *own, *(F.lit(0).cast(df.schema[c].dataType).alias(c) for c in values))
    return kept.unionByName(empty).withColumns({n: F.lit(p) for n, p in zip(SIZES, size)})


def _padding(size: Sequence[int]) -> list[Column]:
    """How far before each sample's first voxel its padded form begins."""
    return [F.floor(F.greatest(F.lit(p) - F.col(n), F.lit(0)) / 2).cast("int") for n, p in zip(SIZES, size)]


def random_patch(df: DataFrame, size: Sequence[int], seed: int) -> DataFrame:
    """Each sample zero-padded to the size and cut to a random box of it."""
    starts = [random_start(F.greatest(F.col(n), F.lit(p)), p, seed, k, "sample_id") - pad for k, (n, p, pad) in enumerate(zip(SIZES, size, _padding(size)))]
    return crop(df, starts, size)


def foreground_patch(df: DataFrame, size: Sequence[int], seed: int, min_foreground: float, attempts: int = 50, label: str = "label", scratch: Scratch | None = None) -> DataFrame:
    """Each sample zero-padded to the size and cut to the first of several random boxes with enough foreground, else to the one with most."""
    sizes = df.select("sample_id", *SIZES).distinct()
    pads = [F.greatest(F.col(n), F.lit(p)).alias(n) for n, p in zip(SIZES, size)]
    samples = sizes.select(F.col("sample_id").alias("i"), F.col("sample_id").alias("volume"), *pads)
    moved = df.withColumns({a: F.col(a) + pad for a, pad in zip(AXES, _padding(size))})
    boxes = foreground_crop(samples, moved.select(F.col("sample_id").alias("volume"), *AXES, label), label, size, min_foreground, attempts, seed, scratch=scratch, padded=True)
    found = boxes.select(F.col("i").alias("sample_id"), *(F.col(a).alias(f"_b{a}") for a in AXES))
    at = df.join(found, "sample_id")
    starts = [F.col(f"_b{a}") - pad for a, pad in zip(AXES, _padding(size))]
    return crop(at, starts, size).drop(*(f"_b{a}" for a in AXES))


def rand_zoom(df: DataFrame, target: Sequence[float] | Sequence[Sequence[float]], seed: int, mode: str = "ratio", prob: float = 1.0, values: Sequence[str] = ("val",), labels: Sequence[str] = ("label",)) -> DataFrame:
    """Samples on the grid of a random resolution within the target, from their own (columns rz, ry, rx); sizes stay."""
    samples = df.select("sample_id", *SIZES, "rz", "ry", "rx").distinct()
    factors = zoom_factors(samples, target, mode, seed=seed).where(uniform(F.lit(seed), F.lit("zoom"), "sample_id") < prob)
    out = zoom_samples(df.select("sample_id", *AXES, *values, *labels), factors.select("sample_id", *(f"zoom_{a}" for a in AXES)), values, labels, sizes=samples.select("sample_id", *SIZES))
    return out.join(samples, "sample_id")


def drop_sections(df: DataFrame, seed: int, most: int, value: str = "val", prob: float = 1.0) -> DataFrame:
    return missing_section(df, random_drops(df.select("sample_id", "d", "z").distinct(), seed, most, prob), value)


def train_steps(
    seed: int, value: str = "val", label: str = "label", size: Sequence[int] | None = None, safe_size: Sequence[int] | None = None, min_foreground: float = 0.0, attempts: int = 50,
    target: Sequence[float] | Sequence[Sequence[float]] | None = None, mode: str = "ratio", zoom_prob: float = 1.0, boundary_target: str | None = None, boundary_prob: float = 1.0,
    parts: bool = False, most_missing: int = 0,
) -> list[Callable[[DataFrame], DataFrame]]:
    """The order for training, of samples (sample_id, z, y, x, d, h, w, value, label; with a target also rz, ry, rx).

    Boundaries out of the label ("both"); pad, and crop at a random place (with min_foreground: the
    first of several with enough) to the size, or to safe_size if there is one; parts relabelled
    and each sample zoomed by its own resolution, then cut to the size; flips, turns and transpositions
    in half of the samples each, shared by image and label; parts relabelled; contrast and noise on
    half of the images each; missing sections; boundaries out of a copy ("semantic").
    """
    first = safe_size or size
    cut = (lambda df: foreground_patch(df, first, seed, min_foreground, attempts, label)) if min_foreground > 0 else (lambda df: random_patch(df, first, seed))
    again = [lambda df: relabel_parts(df, label)] if parts else []
    steps = [lambda df: with_boundaries(df, "both", label, seed, boundary_prob)] if boundary_target == "both" else []
    steps += [cut] if first else []
    if target:
        steps += [*again, lambda df: rand_zoom(df, target, seed, mode, zoom_prob, (value,), (label,))]
        steps += [lambda df: center_crop(df, size)] if safe_size else []
    steps += [lambda df: rand_flip(df, seed), lambda df: rand_rot90(df, seed), lambda df: rand_transpose_xy(df, seed), *again]
    steps += [lambda df: rand_contrast(df, value, seed), lambda df: rand_noise(df, value, seed)]
    steps += [lambda df: drop_sections(df, seed, most_missing, value)] if most_missing else []
    steps += [lambda df: with_boundaries(df, "semantic", label, seed, boundary_prob)] if boundary_target == "semantic" else []
    return steps


def valid_steps(size: Sequence[int], boundary_target: str | None = None, label: str = "label") -> list[Callable[[DataFrame], DataFrame]]:
    """The order for validation: the centre, and boundaries in every sample."""
    return [lambda df: center_crop(df, size)] + ([lambda df: with_boundaries(df, boundary_target, label)] if boundary_target else [])


def sem_label_copy(df: DataFrame, boundary_target: str, label: str = "label", boundary: str = "boundary") -> DataFrame:
    """Erode the label itself ("both") or only a copy sem_label ("semantic")."""
    eroded = F.when(F.col(boundary), 0).otherwise(F.col(label))
    if boundary_target == "both":
        return df.withColumn(label, eroded)
    if boundary_target == "semantic":
        return df.withColumn("sem_label", eroded)
    raise ValueError(f"unknown boundary target {boundary_target!r}")
