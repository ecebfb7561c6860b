"""Evaluation losses as one-pass sums (forward values)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class LossConfig:
    weight_aff: float = 1.0
    weight_sem: float = 1.0
    weight_raw: float = 1.0
    lambda_bce: float = 1.0
    lambda_focal: float = 0.0
    lambda_dice: float = 1.0
    gamma: float = 2.0
    focal_alpha: float | None = None
    class_balance: str | float | None = None
    clip: float = 10.0
    dice_two_sided: bool = False
    eps: float = 1e-6
    pull_weight: float = 1.0
    push_weight: float = 1.0
    n_pull: int = 3
    ignore_index: int = -100
    raw: str = "l1"
    groups: Sequence[str] = field(default_factory=tuple)


def bce_logits(z: Column, t: Column) -> Column:
    """Stable binary cross entropy of a logit."""
    return F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))


def bce_on_probs(p: Column, t: Column, eps: float = 1e-7) -> Column:
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(t * F.log(p) + (1 - t) * F.log(1 - p))


def focal_logits(z: Column, t: Column, gamma: float, alpha: float | None) -> Column:
    p = 1 / (1 + F.exp(-z))
    pt = p * t + (1 - p) * (1 - t)
    out = F.pow(1 - pt, F.lit(gamma)) * bce_logits(z, t)
    return out if alpha is None else (alpha * t + (1 - alpha) * (1 - t)) * out


def class_balance(rows: DataFrame, mode: str | float | None, by: Sequence[str] = (), clip: float = 10.0) -> DataFrame:
    """rows(t, w, by) with the weight cw of each row's class.

    A number multiplies class 1; "auto" gives 0.5/f and 0.5/(1 - f), at most clip, for the
    weighted share f of class 1 in its group.
    """
    if mode in (None, "none"):
        return rows.withColumn("cw", F.lit(1.0))
    if isinstance(mode, (int, float)):
        return rows.withColumn("cw", F.when(F.col("t") > 0.5, float(mode)).otherwise(1.0))
    if mode != "auto":
        raise ValueError(f"unknown class balance {mode!r}")
    share = (F.sum(F.col("t") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-12))).alias("_f")
    f = F.col("_f")
    weight = F.when(F.col("t") > 0.5, F.least(0.5 / F.greatest(f, F.lit(1e-12)), F.lit(clip))).otherwise(F.least(0.5 / F.greatest(1 - f, F.lit(1e-12)), F.lit(clip)))
    stats = rows.groupBy(*by).agg(share)  # one row a group
    joined = rows.join(stats, list(by)) if by else rows.crossJoin(F.broadcast(stats))
    return joined.withColumn("cw", weight).drop("_f")


def composite(rows: DataFrame, cfg: LossConfig, name: str) -> DataFrame:
    """Cross entropy, focal and Dice terms of rows(logit, t, w, cw), weighted by the configuration: one row."""
    z, t, wm = F.col("logit"), F.col("t").cast("double"), F.col("w") * F.col("cw")
    p = 1 / (1 + F.exp(-z))
    s = rows.agg(
        F.sum(wm).alias("w"), F.sum(bce_logits(z, t) * wm).alias("bce"), F.sum(focal_logits(z, t, cfg.gamma, cfg.focal_alpha) * wm).alias("focal"),
        F.sum(p * t * wm).alias("i"), F.sum(p * wm).alias("p"), F.sum(t * wm).alias("t"),
        F.sum((1 - p) * (1 - t) * wm).alias("i0"), F.sum((1 - p) * wm).alias("p0"), F.sum((1 - t) * wm).alias("t0"),
    )
    total = F.greatest(F.col("w"), F.lit(1.0))
    dice = lambda i, a, b: 1 - (2 * F.col(i) + cfg.eps) / (F.col(a) + F.col(b) + cfg.eps)
    d = (dice("i", "p", "t") + dice("i0", "p0", "t0")) / 2 if cfg.dice_two_sided else dice("i", "p", "t")
    return s.select((cfg.lambda_bce * F.col("bce") / total + cfg.lambda_focal * F.col("focal") / total + cfg.lambda_dice * d).alias(name))


def affinity_rows(head: DataFrame, cfg: LossConfig) -> DataFrame:
    """A row (off, logit, t, w) for each voxel and offset, from arrays aff_logit, aff and valid."""
    e = head.select(F.posexplode(F.arrays_zip("aff_logit", "aff", "valid")).alias("off", "e"))
    w = F.when(F.col("off") < cfg.n_pull, cfg.pull_weight).otherwise(cfg.push_weight)
    return e.select("off", F.col("e.aff_logit").alias("logit"), F.col("e.aff").cast("double").alias("t"), (F.col("e.valid").cast("double") * w).alias("w"))


def affinity_loss(head: DataFrame, cfg: LossConfig) -> DataFrame:
    return composite(class_balance(affinity_rows(head, cfg), cfg.class_balance, ["off"], cfg.clip), cfg, "loss_aff")


def sem_loss(head: DataFrame, cfg: LossConfig) -> DataFrame:
    """The same composite on the semantic logit `sem` against label > 0."""
    w = (F.col("label") != cfg.ignore_index).cast("double")
    rows = head.select(F.col("sem").alias("logit"), (F.col("label") > 0).cast("double").alias("t"), w.alias("w"))
    return composite(class_balance(rows, cfg.class_balance, (), cfg.clip), cfg, "loss_sem")


def raw_term(d: Column, name: str) -> Column:
    if name in ("l1", "mae"):
        return F.abs(d)
    if name in ("mse", "l2"):
        return d * d
    if name in ("smooth_l1", "huber"):
        return F.when(F.abs(d) < 1, 0.5 * d * d).otherwise(F.abs(d) - 0.5)
    raise ValueError(f"unknown regression loss {name!r}")


def raw_loss(head: DataFrame, name: str = "l1") -> DataFrame:
    if "image" not in head.columns:
        raise ValueError("the raw loss needs the image")
    return head.agg(F.avg(raw_term(F.col("raw") - F.col("image"), name)).alias("loss_raw"))


def total_loss(head: DataFrame, cfg: LossConfig) -> DataFrame:
    """Terms with a weight and their weighted sum; fields of weight zero are not computed."""
    terms = [("loss_aff", cfg.weight_aff, lambda: affinity_loss(head, cfg)), ("loss_sem", cfg.weight_sem, lambda: sem_loss(head, cfg)), ("loss_raw", cfg.weight_raw, lambda: raw_loss(head, cfg.raw))]
    used = [(n, w, make()) for n, w, make in terms if w]
    out = used[0][2]
    for _, _, df in used[1:]:
        out = out.crossJoin(F.broadcast(df))  # one row each
    return out.withColumn("loss", sum((F.col(n) * w for n, w, _ in used), F.lit(0.0)))
