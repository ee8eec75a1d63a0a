"""Data with known truth: ``spark.range`` and hashed normals, the same for a seed however rows are partitioned."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import expit, lit


def uniform(name: str, seed: int) -> Column:
    return (F.shiftrightunsigned(F.xxhash64("id", F.lit(name), F.lit(seed)), 11) + lit(0.5)) / lit(2.0**53)


def normal(name: str, seed: int) -> Column:
    """Box-Muller on two hashed uniforms."""
    return F.sqrt(lit(-2) * F.log(uniform(name + "/u", seed))) * F.cos(lit(2 * math.pi) * uniform(name + "/v", seed))


def _base(spark: SparkSession, n: int, p: int, seed: int) -> DataFrame:
    return spark.range(n).withColumns({f"W{j}": normal(f"W{j}", seed) for j in range(1, p + 1)})


def _draw(df: DataFrame, name: str, p: Column, seed: int) -> DataFrame:
    return df.withColumn(name, F.when(uniform(name, seed) < p, lit(1)).otherwise(lit(0)))


def _mean_of(f, *sds: float, nodes: int = 60) -> float:
    """Mean of a function of independent centred normals with these standard deviations, by Gauss-Hermite quadrature."""
    x, w = np.polynomial.hermite_e.hermegauss(nodes)
    grids = np.meshgrid(*(x * s for s in sds), indexing="ij")
    weights = np.ones_like(grids[0])
    for g in np.meshgrid(*([w / w.sum()] * len(sds)), indexing="ij"):
        weights = weights * g
    return float((weights * f(*grids)).sum())


def _logistic(x):
    return 1 / (1 + np.exp(-x))


def _binary_truth(p1: float, p0: float) -> dict[str, float]:
    odds = lambda p: p / (1 - p)
    return {"ey1": p1, "ey0": p0, "ate": p1 - p0, "rr": p1 / p0, "or": odds(p1) / odds(p0)}


def linear_ate(spark: SparkSession, n: int = 1000, *, seed: int = 0, effect: float = 1.5) -> tuple[DataFrame, dict[str, float]]:
    """Linear outcome with a constant effect."""
    w = [F.col(f"W{j}") for j in range(1, 5)]
    df = _draw(_base(spark, n, 4, seed), "A", expit(lit(0.3) * w[0] - lit(0.2) * w[1] + lit(0.1) * w[2]), seed)
    y = lit(2) + lit(effect) * F.col("A") + w[0] + lit(0.5) * w[1] - lit(0.8) * w[2] + lit(0.4) * w[3] + normal("e", seed)
    return df.withColumn("Y", y), {"ate": effect, "att": effect, "atc": effect}


def heterogeneous(spark: SparkSession, n: int = 1000, *, seed: int = 0, slope: float = 1.5) -> tuple[DataFrame, dict[str, float]]:
    """An effect 1 + slope * W1 and a treatment that is likelier with W1."""
    w = [F.col("W1"), F.col("W2")]
    df = _draw(_base(spark, n, 2, seed), "A", expit(lit(0.8) * w[0]), seed)
    return df.withColumn("Y", lit(1) + F.col("A") * (lit(1) + lit(slope) * w[0]) + w[1] + normal("e", seed)), {"ate": 1.0}


def weak_overlap(spark: SparkSession, n: int = 1000, *, seed: int = 0, strength: float = 3.0) -> tuple[DataFrame, dict[str, float]]:
    w = [F.col(f"W{j}") for j in range(1, 4)]
    df = _draw(_base(spark, n, 3, seed), "A", expit(lit(strength) * w[0] + lit(0.7 * strength) * w[1]), seed)
    return df.withColumn("Y", lit(1) + F.col("A") + lit(1.5) * w[0] + w[1] + lit(0.5) * w[2] + normal("e", seed)), {"ate": 1.0}


def binary_outcome(spark: SparkSession, n: int = 1000, *, seed: int = 0) -> tuple[DataFrame, dict[str, float]]:
    w = [F.col(f"W{j}") for j in range(1, 4)]
    df = _draw(_base(spark, n, 3, seed), "A", expit(lit(0.4) * w[0] - lit(0.3) * w[1] + lit(0.2) * w[2]), seed)
    eta = lambda a: lit(-0.6) + lit(0.9) * a + lit(0.7) * w[0] - lit(0.5) * w[1] + lit(0.4) * w[2]
    return _draw(df, "Y", expit(eta(F.col("A"))), seed), _binary_means()


def _binary_means() -> dict[str, float]:
    """The linear predictor is normal around -0.6 + 0.9 a."""
    sd = math.sqrt(0.7**2 + 0.5**2 + 0.4**2)
    return _binary_truth(*(_mean_of(lambda z, a=a: _logistic(-0.6 + 0.9 * a + z), sd) for a in (1, 0)))


def missing_outcome_binary(spark: SparkSession, n: int = 1000, *, seed: int = 0) -> tuple[DataFrame, dict[str, float]]:
    """A binary outcome that is missing at random given treatment and covariates."""
    df, truth = binary_outcome(spark, n, seed=seed)
    df = _draw(df, "Delta", expit(lit(1) + lit(0.5) * F.col("A") - lit(0.9) * F.col("W1") + lit(0.4) * F.col("W2")), seed)
    return df.withColumn("Y", F.when(F.col("Delta") == 1, F.col("Y"))), truth


def missing_outcome(spark: SparkSession, n: int = 1000, *, seed: int = 0, strength: float = 1.0) -> tuple[DataFrame, dict[str, float]]:
    """Outcomes missing at random; above strength 1 the outcome is curved and the mechanism sharper, which biases complete cases."""
    extra = strength - 1.0
    w = [F.col(f"W{j}") for j in range(1, 4)]
    df = _draw(_base(spark, n, 3, seed), "A", expit(lit(0.4) * w[0] - lit(0.3) * w[1] + lit(0.2) * w[2]), seed)
    df = _draw(df, "Delta", expit(lit(1.2) + lit(0.6) * F.col("A") - lit(0.8 + 0.6 * extra) * w[0] + lit(0.3) * w[2]), seed)
    y = lit(1) + lit(1.2) * F.col("A") + lit(0.9) * w[0] + lit(0.6) * w[1] - lit(0.4) * w[2] + normal("e", seed)
    if extra:
        y = y + lit(extra) * (lit(1.1) * F.tanh(lit(1.5) * w[0]) + lit(0.8) * w[1] ** 2 - lit(0.9) * F.col("A") * w[0])
    return df.withColumn("Y", F.when(F.col("Delta") == 1, y)), {"ate": 1.2}


def intermediate(spark: SparkSession, n: int = 1000, *, seed: int = 0) -> tuple[DataFrame, dict[str, float]]:
    w = [F.col(f"W{j}") for j in range(1, 4)]
    df = _draw(_base(spark, n, 3, seed), "A", expit(lit(0.3) * w[0] + lit(0.2) * w[1]), seed)
    df = _draw(df, "Z", expit(lit(-0.3) + lit(1.1) * F.col("A") + lit(0.5) * w[0] - lit(0.4) * w[2]), seed)
    y = lit(0.5) + lit(0.9) * F.col("A") + lit(1.4) * F.col("Z") + lit(0.6) * F.col("A") * F.col("Z") + lit(0.8) * w[0] - lit(0.5) * w[1] + lit(0.3) * w[2] + normal("e", seed)
    return df.withColumn("Y", y), {"cde0": 0.9, "cde1": 1.5}


def clustered(spark: SparkSession, n: int = 1000, *, seed: int = 0, cluster_size: int = 10) -> tuple[DataFrame, dict[str, float]]:
    """A hidden modifier shared within clusters."""
    df = _base(spark, n, 2, seed).withColumn("cluster", F.floor(F.col("id") / cluster_size).cast("long"))
    df = _draw(df, "A", expit(lit(0.3) * F.col("W1") + lit(0.6) * F.col("W2")), seed)
    u = (F.shiftrightunsigned(F.xxhash64("cluster", F.lit("U"), F.lit(seed)), 11) / lit(2.0**53) - lit(0.5)) * lit(math.sqrt(12))
    return df.withColumn("Y", lit(1) + F.col("A") + lit(0.8) * F.col("W1") + lit(0.5) * F.col("W2") + lit(1.5) * u + lit(2) * F.col("A") * u + normal("e", seed)), {"ate": 1.0}


def biased_sample(spark: SparkSession, n: int = 2000, *, seed: int = 0) -> tuple[DataFrame, dict[str, float]]:
    """Rows kept with a known probability, and its inverse as a weight."""
    df = _draw(_base(spark, n, 2, seed), "A", expit(lit(0.4) * F.col("W1") - lit(0.3) * F.col("W2")), seed)
    df = df.withColumn("Y", lit(1) + F.col("W1") + lit(0.5) * F.col("W2") + F.col("A") * (lit(1) + lit(1.2) * F.col("W1")) + normal("e", seed))
    df = df.withColumn("sampling_prob", expit(lit(-0.5) + F.col("W1")))
    return df.where(uniform("keep", seed) < F.col("sampling_prob")).withColumn("sampling_weight", lit(1) / F.col("sampling_prob")), {"ate": 1.0}


def multi_arm(spark: SparkSession, n: int = 1500, *, seed: int = 0) -> tuple[DataFrame, dict[str, float]]:
    df = _base(spark, n, 3, seed)
    e1, e2 = F.exp(lit(0.8) * F.col("W1") - lit(0.4) * F.col("W2")), F.exp(lit(-0.5) * F.col("W1") + lit(0.8) * F.col("W2"))
    u, s = uniform("A", seed), lit(1) + F.exp(lit(0.8) * F.col("W1") - lit(0.4) * F.col("W2")) + F.exp(lit(-0.5) * F.col("W1") + lit(0.8) * F.col("W2"))
    df = df.withColumn("A", F.when(u < lit(1) / s, "low").when(u < (lit(1) + e1) / s, "medium").otherwise(F.when(e2 > 0, "high")))
    step = F.when(F.col("A") == "medium", lit(1)).when(F.col("A") == "high", lit(2.4)).otherwise(lit(0))
    return df.withColumn("Y", step + F.col("W1") - lit(0.5) * F.col("W2") + lit(0.2) * F.col("W3") + lit(0.8) * normal("e", seed)), {"ate[medium vs low]": 1.0, "ate[high vs low]": 2.4}


def shift_dose(spark: SparkSession, n: int = 2000, *, seed: int = 0) -> tuple[DataFrame, dict[str, float]]:
    """A quadratic response to a normal dose; the truth is the gain of moving everyone up by 0.5."""
    df = _base(spark, n, 3, seed).withColumn("A", lit(2) + lit(0.7) * F.col("W1") - lit(0.3) * F.col("W2") + normal("A", seed))
    y = lit(1) + lit(0.5) * F.col("A") + lit(0.25) * F.col("A") ** 2 + F.col("W1") - lit(0.5) * F.col("W2") + lit(0.2) * F.col("W3") + lit(0.8) * normal("e", seed)
    return df.withColumn("Y", y), {"gain_0.5": 0.25 + 0.25 * (2 * 2 * 0.5 + 0.25)}


def longitudinal(spark: SparkSession, n: int = 2000, *, seed: int = 0) -> tuple[DataFrame, dict[str, float]]:
    """Two times with monotone censoring and a covariate in between; nodes after censoring are null."""
    df = _draw(_base(spark, n, 2, seed), "A1", expit(lit(0.3) * F.col("W1") - lit(0.4) * F.col("W2")), seed)
    df = _draw(df, "C1", expit(lit(2.2) + lit(0.3) * F.col("W1") - lit(0.3) * F.col("A1")), seed)
    df = df.withColumn("L2", F.when(F.col("C1") == 1, lit(0.5) * F.col("W1") + lit(0.4) * F.col("A1") + normal("L2", seed)))
    df = _draw(df, "draw_a", expit(lit(0.5) * F.col("L2") + lit(0.6) * F.col("A1") - lit(0.2) * F.col("W2")), seed)
    df = df.withColumn("A2", F.when(F.col("C1") == 1, F.col("draw_a")))
    df = _draw(df, "draw_c", expit(lit(2.4) + lit(0.2) * F.col("L2")), seed).withColumn("C2", F.when(F.col("C1") == 1, F.col("draw_c")).otherwise(lit(0)))
    df = _draw(df, "draw_y", expit(lit(-0.5) + lit(0.5) * F.col("A1") + lit(0.6) * F.col("A2") + lit(0.4) * F.col("L2") + lit(0.3) * F.col("W1")), seed)
    return df.withColumn("Y", F.when(F.col("C2") == 1, F.col("draw_y"))).drop("draw_a", "draw_c", "draw_y"), {f"ey[{a}{b}]": _mean_of(lambda w, e, a=a, b=b: _logistic(-0.5 + 0.66 * a + 0.6 * b + 0.5 * w + 0.4 * e), 1, 1) for a in (0, 1) for b in (0, 1)}


def nonlinear_ate(spark: SparkSession, n: int = 1000, *, seed: int = 0) -> tuple[DataFrame, dict[str, float]]:
    """Nonlinear confounding and an effect 2 + 0.7 W1 - 0.5 [W2 > 0]."""
    w = [F.col(f"W{j}") for j in range(1, 5)]
    pos = lambda c: F.when(c > 0, lit(1)).otherwise(lit(0))
    df = _draw(_base(spark, n, 4, seed), "A", expit(lit(0.6) * w[0] - lit(0.4) * w[1] ** 2 + lit(0.5) * w[1] * w[2] + lit(0.3) * pos(w[3])), seed)
    base = lit(1) + lit(0.8) * F.sin(lit(1.5) * w[0]) + lit(0.6) * w[1] ** 2 - lit(0.5) * w[2] * w[3] + lit(0.4) * F.abs(w[3])
    return df.withColumn("Y", base + F.col("A") * (lit(2) + lit(0.7) * w[0] - lit(0.5) * pos(w[1])) + normal("e", seed)), {"ate": 1.75}


def instrument(spark: SparkSession, n: int = 1000, *, seed: int = 0, strength: float = 1.5) -> tuple[DataFrame, dict[str, float]]:
    """W2 moves the treatment alone, W3 the outcome alone."""
    df = _draw(_base(spark, n, 3, seed), "A", expit(lit(0.8) * F.col("W1") + lit(strength) * F.col("W2")), seed)
    return df.withColumn("Y", lit(1) + F.col("A") + lit(1.5) * F.col("W1") + lit(0.8) * F.col("W3") + normal("e", seed)), {"ate": 1.0}


def longitudinal_weighted(spark: SparkSession, n: int = 3000, *, seed: int = 0) -> tuple[DataFrame, dict[str, float]]:
    """The longitudinal study kept with probability 0.3 where W1 > 0 and 0.9 elsewhere, with the inverse as a weight."""
    df, truth = longitudinal(spark, n, seed=seed)
    keep = F.when(F.col("W1") > 0, lit(0.3)).otherwise(lit(0.9))
    return df.where(uniform("keep", seed) < keep).withColumn("weight", lit(1) / keep), truth


def longitudinal_survival(spark: SparkSession, n: int = 2000, *, seed: int = 0, causes: int = 1) -> tuple[DataFrame, dict[str, float]]:
    """Two times with an absorbing event, or with competing causes that share the hazard; events are carried forward."""
    df = _draw(_base(spark, n, 2, seed), "A1", expit(lit(0.3) * F.col("W1") - lit(0.4) * F.col("W2")), seed)
    df = _draw(df, "C1", expit(lit(2.2) + lit(0.3) * F.col("W1")), seed)
    df = _draw(df, "hit1", expit(lit(-1.4) - lit(0.5) * F.col("A1") + lit(0.4) * F.col("W1")), seed)
    df = _draw(df, "kind1", lit(0.6), seed)
    live = (F.col("C1") == 1) & (F.col("hit1") == 0)
    df = df.withColumn("L2", F.when(live, lit(0.5) * F.col("W1") + lit(0.4) * F.col("A1") + normal("L2", seed)))
    df = _draw(df, "draw_a", expit(lit(0.5) * F.coalesce("L2", lit(0)) + lit(0.6) * F.col("A1")), seed).withColumn("A2", F.when(live, F.col("draw_a")))
    df = _draw(df, "draw_c", expit(lit(2.4) + lit(0.2) * F.coalesce("L2", lit(0))), seed)
    df = df.withColumn("C2", F.when(F.col("C1") == 1, F.when(F.col("hit1") == 1, lit(1)).otherwise(F.col("draw_c"))).otherwise(lit(0)))
    df = _draw(df, "hit2", expit(lit(-1.0) - lit(0.5) * F.coalesce("A2", lit(0)) + lit(0.3) * F.coalesce("L2", lit(0))), seed)
    df = _draw(df, "kind2", lit(0.6), seed)
    seen1 = (F.col("C1") == 1) & (F.col("hit1") == 1)
    seen2 = seen1 | (live & (F.col("C2") == 1) & (F.col("hit2") == 1))
    late = F.when(seen1, F.col("kind1")).otherwise(F.col("kind2"))
    one = lambda c: F.when(c, lit(1)).otherwise(lit(0))
    if causes == 1:
        df = df.withColumns({"Y1": one(seen1), "Y2": one(seen2)})
    else:
        df = df.withColumns({"R1": one(seen1 & (F.col("kind1") == 1)), "D1": one(seen1 & (F.col("kind1") == 0)), "R2": one(seen2 & (late == 1)), "D2": one(seen2 & (late == 0))})
    truth = {}
    for a in (0, 1):
        for b in (0, 1):
            first = lambda w, a=a: _logistic(-1.4 - 0.5 * a + 0.4 * w)
            risk = _mean_of(lambda w, e, a=a, b=b: first(w) + (1 - first(w)) * _logistic(-1.0 - 0.5 * b + 0.3 * (0.5 * w + 0.4 * a + e)), 1, 1)  # noqa: B023
            truth |= {f"risk[{a}{b}, t1]": _mean_of(first, 1), f"risk[{a}{b}, t2]": risk} if causes == 1 else {f"cif[{a}{b}, r, t2]": 0.6 * risk, f"cif[{a}{b}, d, t2]": 0.4 * risk}
    return df.drop("hit1", "hit2", "kind1", "kind2", "draw_a", "draw_c"), truth
