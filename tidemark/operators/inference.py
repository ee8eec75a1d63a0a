"""Estimates from influence curves: variances, clusters, covariances, the delta method, bands and resampling."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StudyError
from ..functions.expr import lit
from .learn import FOLD


@dataclass(frozen=True)
class Estimate:
    """One reported parameter.  For ratios the curve and ``std_err`` are those of the logarithm."""

    name: str
    psi: float
    std_err: float
    scale: str
    n: int
    alpha: float = 0.05
    estimand: str = ""
    arm: str = ""
    reference: str = ""
    stratum: str = ""
    axis: str = "arm"

    @property
    def center(self) -> float:
        return math.log(self.psi) if self.scale == "ratio" else self.psi

    def interval(self, critical: float | None = None) -> tuple[float, float]:
        z = NormalDist().inv_cdf(1 - self.alpha / 2) if critical is None else critical
        low, high = self.center - z * self.std_err, self.center + z * self.std_err
        return (math.exp(low), math.exp(high)) if self.scale == "ratio" else (low, high)

    @property
    def p_value(self) -> float:
        return two_sided_p(self.center, self.std_err)

    def row(self) -> tuple:
        low, high = self.interval()
        return self.name, self.psi, self.std_err, low, high, self.p_value, self.scale


ROW = "estimand string, psi double, std_err double, ci_lower double, ci_upper double, p_value double, scale string"


def two_sided_p(estimate: float, std_err: float) -> float:
    return math.erfc(abs(estimate) / std_err / math.sqrt(2)) if std_err > 0 else float("nan")


def frame_of(spark, estimates: Sequence[Estimate]) -> DataFrame:
    return spark.createDataFrame([e.row() for e in estimates], ROW)


@dataclass(frozen=True)
class ParameterKey:
    """What a reported parameter is, by its parts and not by its name."""

    alias: str
    estimand: str
    axis: str
    value: str = ""
    reference: str = ""
    stratum: str = ""


def parameter_key(e: Estimate) -> ParameterKey:
    return ParameterKey(e.name, e.estimand or e.name, e.axis, e.arm, e.reference, e.stratum)


def arm_parameters(estimates: Sequence[Estimate]) -> dict[str, tuple[str, ...]]:
    """Reported name -> the arms it speaks of, the reference last; only parameters on the arm axis."""
    return {e.name: tuple(x for x in (e.arm, e.reference) if x) for e in estimates if e.axis == "arm"}


def select_estimates(estimates: Sequence[Estimate], names: Sequence[str]) -> list[Estimate]:
    """The named estimates in the order asked for; unknown names are refused."""
    known = {e.name: e for e in estimates}
    unknown = [n for n in names if n not in known]
    if unknown:
        raise StudyError(f"no parameters {unknown}; there are {list(known)}")
    return [known[n] for n in names]


def coefficient_frame(spark, estimates: Sequence[Estimate], scale: str = "link") -> DataFrame:
    """(term, psi, std_err, ci_lower, ci_upper) of a working model's coefficients."""
    if scale not in ("link", "ratio"):
        raise StudyError(f"unknown scale {scale!r}")
    held = [e for e in estimates if e.estimand == "msm"]
    if not held:
        raise StudyError("the result has no working model")
    turn = math.exp if scale == "ratio" else float
    return spark.createDataFrame([(e.arm, turn(e.psi), e.std_err, *map(turn, e.interval())) for e in held], "term string, psi double, std_err double, ci_lower double, ci_upper double")


def repeat_spread(spark, repeats: Sequence[Sequence[Estimate]]) -> DataFrame:
    """(estimand, repeats, mean, spread): how much an estimate moves between repeated cross-fits, on its centre's scale."""
    rows = []
    for same in zip(*repeats, strict=True):
        values = np.array([e.center for e in same])
        rows.append((same[0].name, len(values), float(values.mean()), float(values.std(ddof=1)) if len(values) > 1 else 0.0))
    return spark.createDataFrame(rows, "estimand string, repeats int, mean double, spread double")


def covariance(rows: DataFrame, names: Sequence[str], cluster: str | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(means, covariance of the estimates, n) from IC columns: one aggregate, after sums by cluster if there are any."""
    d = len(names)
    if cluster is None:
        units = rows
    else:
        units = rows.groupBy(cluster).agg(*(F.sum(c).alias(c) for c in names), F.count("*").alias("cluster__n"))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    r = list(units.agg(F.count("*"), F.sum(F.col("cluster__n")) if cluster else F.count("*"), *(F.sum(c) for c in names), *(F.covar_samp(names[i], names[j]) for i, j in pairs)).first())
    units_n, n = r[0], r[1]
    cov = np.zeros((d, d))
    for (i, j), v in zip(pairs, r[2 + d :], strict=True):
        cov[i, j] = cov[j, i] = v * (units_n / n**2 if cluster else 1 / n)
    return np.array([(v or 0.0) / n for v in r[2 : 2 + d]]), cov, n


def cross_validated_variance(rows: DataFrame, names: Sequence[str], cluster: str | None = None) -> np.ndarray:
    """V**-2 sum over folds of n_v**-2 sum IC**2, uncentred; clusters are summed within their fold."""
    keys = [FOLD] + ([cluster] if cluster else [])
    parts = rows.groupBy(*keys).agg(*(F.sum(F.col(c)).alias(c) for c in names), F.count("*").alias("m")) if cluster else rows.select(FOLD, *names, F.lit(1).alias("m"))
    byfold = parts.groupBy(FOLD).agg(F.sum("m").alias("n"), *(F.sum(F.col(c) ** 2).alias(c) for c in names)).collect()
    v = len(byfold)
    return np.array([sum(r[c] / r["n"] ** 2 for r in byfold) / v**2 for c in names])


def delta_gradient(function: Callable[[np.ndarray], float], at: np.ndarray, step: float = 1e-6) -> np.ndarray:
    out = np.zeros(len(at))
    for i in range(len(at)):
        e = np.zeros(len(at))
        e[i] = step * max(1.0, abs(at[i]))
        out[i] = (function(at + e) - function(at - e)) / (2 * e[i])
    return out


def smooth_contrast(function: Callable[[np.ndarray], float], estimates: Sequence[Estimate], cov: np.ndarray, *, name: str = "contrast", scale: str = "difference", gradient: np.ndarray | None = None) -> Estimate:
    """Any smooth function of reported parameters; covariances are on each estimate's own scale."""
    at = np.array([e.psi for e in estimates])
    g = delta_gradient(function, at) if gradient is None else np.asarray(gradient, float)
    g = g * np.array([e.psi if e.scale == "ratio" else 1.0 for e in estimates])
    psi = float(function(at))
    se = math.sqrt(max(float(g @ cov @ g), 0.0))
    return Estimate(name, psi, se / psi if scale == "ratio" else se, scale, estimates[0].n, estimates[0].alpha)


def normal_critical(cov: np.ndarray, *, alpha: float = 0.05, draws: int = 100_000, seed: int = 0) -> float:
    """The 1 - alpha quantile of max |t| for a Gaussian vector with this covariance, drawn on the driver."""
    se = np.sqrt(np.diag(cov))
    use = se > 0
    corr = cov[np.ix_(use, use)] / np.outer(se[use], se[use])
    value, vector = np.linalg.eigh(corr)
    root = vector * np.sqrt(np.maximum(value, 0))
    z = np.random.default_rng(seed).standard_normal((draws, use.sum())) @ root.T
    return float(np.quantile(np.abs(z).max(axis=1), 1 - alpha))


def multiplier_critical(rows: DataFrame, names: Sequence[str], std_errs: Sequence[float], *, key: str = "id", cluster: str | None = None, alpha: float = 0.05, draws: int = 1000, kind: str = "rademacher", seed: int = 0) -> float:
    """The same quantile by multipliers: each partition adds its rows' part of every draw.

    A multiplier is a hash of the unit and the seed, so partitioning cannot change it.
    """
    if kind not in ("rademacher", "mammen"):
        raise StudyError(f"unknown multipliers {kind!r}")
    unit = cluster or key
    units = rows.groupBy(cluster).agg(*(F.sum(c).alias(c) for c in names)) if cluster else rows.select(key, *names)
    n = rows.count()
    means = list(units.agg(*(F.avg(c) for c in names)).first())
    seeded = units.select(F.xxhash64(F.col(unit), F.lit(seed)).alias("h"), *((F.col(c) - lit(m)).alias(c) for c, m in zip(names, means, strict=True)))
    d = len(names)

    def partial(batches):
        import pandas as pd

        sums = np.zeros((draws, d))
        for pdf in batches:
            x = pdf[names].to_numpy(float)
            h = pdf["h"].to_numpy(np.int64)
            for i in range(0, len(h), 256):
                u = np.stack([np.random.default_rng(int(v) & 0x7FFFFFFFFFFFFFFF).random(draws) for v in h[i : i + 256]])
                if kind == "rademacher":
                    xi = np.where(u < 0.5, -1.0, 1.0)
                else:
                    root = math.sqrt(5)
                    xi = np.where(u < (root + 1) / (2 * root), -(root - 1) / 2, (root + 1) / 2)
                sums += xi.T @ x[i : i + 256]
        yield pd.DataFrame({"b": np.repeat(np.arange(draws), d), "j": np.tile(np.arange(d), draws), "v": sums.ravel()})

    names = list(names)
    byb = seeded.mapInPandas(partial, "b int, j int, v double").groupBy("b", "j").agg(F.sum("v").alias("v"))
    se = F.element_at(F.array(*(lit(max(s, 1e-300)) for s in std_errs)), F.col("j") + 1)
    top = byb.groupBy("b").agg(F.max(F.abs(F.col("v")) / lit(n) / se).alias("t"))
    return float(top.agg(F.percentile("t", F.lit(1 - alpha))).first()[0])


def bands(estimates: Sequence[Estimate], critical: float) -> list[tuple[str, float, float]]:
    return [(e.name, *e.interval(critical)) for e in estimates]


def bh_adjust(df: DataFrame, p: str, key: str) -> DataFrame:
    """Benjamini-Hochberg step-up over a small table of p-values."""
    from pyspark.sql import Window as W

    m = F.count("*").over(W.partitionBy())
    ranked = df.withColumn("bh__r", F.row_number().over(W.orderBy(p, key))).withColumn("bh__m", m)
    up = W.orderBy(F.desc("bh__r")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return ranked.withColumn("p_adjusted", F.least(F.min(F.col(p) * F.col("bh__m") / F.col("bh__r")).over(up), lit(1))).drop("bh__r", "bh__m")


def bootstrap_weights(df: DataFrame, replicate: int | Column, *, unit: str = "id", seed: int = 0) -> DataFrame:
    """``w`` times a Poisson(1) count of the unit: the usual approximation to drawing units with replacement.

    The count is read off a hash of unit, replicate and seed by inverting the distribution function.
    """
    u = (F.shiftrightunsigned(F.xxhash64(F.col(unit), F.lit(replicate), F.lit(seed)), 11)) / lit(2.0**53)
    mass = below = math.exp(-1)
    count = F.when(u < lit(below), F.lit(0))
    for k in range(1, 12):
        mass /= k
        below += mass
        count = count.when(u < lit(below), F.lit(k))
    return df.withColumn("w", F.col("w") * count.otherwise(F.lit(12)))


def ranked_units(df: DataFrame, unit: str, seed: int) -> DataFrame:
    """(unit, rank) from 0 in the order of a hash; ranks are counted by ranges of the hash first, so no order needs one task."""
    from pyspark.sql import Window as W

    units = df.select(unit).distinct().withColumn("h", F.xxhash64(F.col(unit), F.lit(seed))).withColumn("part", F.shiftright("h", 52))
    parts = units.groupBy("part").agg(F.count("*").alias("c"))
    parts = parts.withColumn("ahead", F.coalesce(F.sum("c").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("c")
    units = units.withColumn("r", F.row_number().over(W.partitionBy("part").orderBy("h", unit)) - 1)
    return units.join(parts, "part").select(unit, (F.col("r") + F.col("ahead")).alias("rank"))


def multinomial_weights(df: DataFrame, replicate: int, *, unit: str = "id", seed: int = 0) -> DataFrame:
    """``w`` times how often the unit is among as many draws with replacement as there are units.

    Draw j of a replicate is a hash of j, so the counts add up to the number of units exactly.
    """
    units = ranked_units(df, unit, seed)
    n = units.count()
    u = F.shiftrightunsigned(F.xxhash64("id", F.lit(replicate), F.lit(seed)), 11) / lit(2.0**53)
    drawn = df.sparkSession.range(n).select(F.floor(u * n).alias("rank")).groupBy("rank").agg(F.count("*").alias("times__"))
    counts = units.join(drawn, "rank").select(unit, "times__")
    return df.join(counts, unit, "left").withColumn("w", F.col("w") * F.coalesce("times__", F.lit(0))).drop("times__")


def map_parallel(function: Callable, items: Sequence, parallel: int = 4) -> list:
    """``function`` of every item, a few at a time: each call submits Spark jobs of its own, whose results keep the items' order."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        return list(pool.map(function, items))


def run_bootstrap(df: DataFrame, refit: Callable[[DataFrame], Mapping[str, float]], *, replicates: int = 50, unit: str = "id", seed: int = 0, parallel: int = 4, exact: bool = False, draw: Callable[[int], DataFrame] | None = None) -> dict[str, np.ndarray]:
    """Full refits under resampled weights, a few jobs at a time; failed replicates are dropped and counted.

    Counts are Poisson by default, which needs no shuffle; ``exact`` draws them with replacement.  ``draw`` gives
    the weighted frame of a replicate where the caller has a shorter way to it.
    """
    weigh = multinomial_weights if exact else bootstrap_weights
    draw = draw or (lambda b: weigh(df, b, unit=unit, seed=seed))

    def one(b: int) -> Mapping[str, float] | None:
        try:
            return refit(draw(b))
        except (StudyError, np.linalg.LinAlgError):
            return None

    found = [r for r in map_parallel(one, range(replicates), parallel) if r]
    out = {k: np.array([r[k] for r in found]) for k in (found[0] if found else {})}
    out["__failed"] = np.array([replicates - len(found)])
    return out


def bootstrap_summary(draws: np.ndarray, alpha: float = 0.05) -> dict[str, float]:
    return {"std_err": float(draws.std(ddof=1)), "ci_lower": float(np.quantile(draws, alpha / 2)), "ci_upper": float(np.quantile(draws, 1 - alpha / 2)), "lower_bound": float(np.quantile(draws, alpha)), "upper_bound": float(np.quantile(draws, 1 - alpha))}


def average_repeats(repeats: Sequence[Sequence[Estimate]], cov: np.ndarray) -> list[Estimate]:
    """Mean over repeats (of logarithms for ratios); ``cov`` is that of the averaged curves."""
    out = []
    for j, same in enumerate(zip(*repeats, strict=True)):
        center = sum(e.center for e in same) / len(same)
        out.append(replace(same[0], psi=math.exp(center) if same[0].scale == "ratio" else center, std_err=math.sqrt(cov[j, j])))
    return out


