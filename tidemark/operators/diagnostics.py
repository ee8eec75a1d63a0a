"""What a fit looks like: overlap, scores, the quality of nuisances, calibration, weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..design import PointFrame
from ..functions.expr import clip, indicator, lit, logit
from .learn import LogisticNewton, Task
from .order import quantiles
from .point import Nuisances, Result, setting

THRESHOLDS = (0.01, 0.025, 0.05, 0.1)
QUANTILES = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


def positivity(n: Nuisances) -> DataFrame:
    """Per arm: quantiles of g over all rows, tail mass, effective size and largest share of the weights, truncated share."""
    f, s = n.frame, setting(n)
    rows = []
    names = [f"q{str(q)[2:] if 0 < q < 1 else int(q)}" for q in QUANTILES]
    for k in range(f.arms):
        g = F.col(f"g_{k}")
        v = F.col("w") * indicator(F.col("a") == k) / s.g(k)
        r = n.df.select(g.alias("g"), v.alias("v"), s.g(k).alias("b"), F.col("w")).agg(
            *((F.sum(F.col("w") * indicator(F.col("g") < t)) / F.sum("w")).alias(f"below_{str(t)[2:]}") for t in THRESHOLDS),
            (F.sum("v") ** 2 / F.sum(F.col("v") ** 2)).alias("effective_n"), (F.max("v") / F.sum("v")).alias("top_share"), F.avg(indicator(F.abs(F.col("g") - F.col("b")) > 1e-15)).alias("truncated"),
        ).first()
        rows.append((str(f.levels[k]), *quantiles(n.df, g, QUANTILES, f.n), *map(float, r)))
    columns = [*names, *(f"below_{str(t)[2:]}" for t in THRESHOLDS), "effective_n", "top_share", "truncated"]
    return n.df.sparkSession.createDataFrame(rows, "arm string, " + ", ".join(f"{c} double" for c in columns))


def pairwise_positivity(n: Nuisances) -> DataFrame:
    """(arm, versus, q01, median, below_05): overlap of g_k / (g_k + g_j) for every pair of arms."""
    f, rows = n.frame, []
    for k in range(f.arms):
        for j in range(k):
            both = n.df.where(F.col("a").isin(j, k)).select((F.col(f"g_{k}") / (F.col(f"g_{k}") + F.col(f"g_{j}"))).alias("p"), "w")
            low, median = quantiles(both, "p", (0.01, 0.5))
            rows.append((str(f.levels[k]), str(f.levels[j]), low, median, float(both.agg(F.sum(F.col("w") * indicator(F.least("p", lit(1) - F.col("p")) < 0.05)) / F.sum("w")).first()[0])))
    return n.df.sparkSession.createDataFrame(rows, "arm string, versus string, q01 double, median double, below_05 double")


def mechanism_overlap(n: Nuisances) -> DataFrame:
    """(mechanism, arm, min, q05, median, below_05, truncated): the observation and intermediate mechanisms and g times them, for every arm."""
    f, s, rows = n.frame, setting(n), []
    for k in range(f.arms):
        parts = {}
        if f.has_delta:
            parts["pi"] = (F.col(f"pi_{k}"), s.pi(k))
        if n.z is not None:
            parts["qz"] = (F.col(f"qz_{k}") if n.z == 1 else lit(1) - F.col(f"qz_{k}"), s.qz(k))
        if parts:
            whole, cut = F.col(f"g_{k}"), s.g(k)
            for raw, bounded in parts.values():
                whole, cut = whole * raw, cut * bounded
            parts["joint"] = (whole, cut)
        for name, (raw, bounded) in parts.items():
            low, five, median = quantiles(n.df, raw, (0.0, 0.05, 0.5), f.n)
            r = n.df.agg(F.sum(F.col("w") * indicator(raw < 0.05)) / F.sum("w"), F.avg(indicator(F.abs(raw - bounded) > 1e-15))).first()
            rows.append((name, str(f.levels[k]), low, five, median, float(r[0]), float(r[1])))
    return n.df.sparkSession.createDataFrame(rows, "mechanism string, arm string, min double, q05 double, median double, below_05 double, truncated double")


def strata_table(f: PointFrame) -> DataFrame:
    """(stratum, arm, n, weight, mean) by stratum and arm, with the margins of both: null stands for all."""
    arm = F.element_at(F.array(*(F.lit(str(v)) for v in f.levels)), F.col("a") + 1)
    rows = f.df.select(F.col("s").alias("stratum"), arm.alias("arm"), "w", "y", "delta")
    seen = F.when(F.col("delta") == 1, F.col("w"))
    return rows.cube("stratum", "arm").agg(F.count("*").alias("n"), F.sum("w").alias("weight"), (F.sum(seen * F.col("y")) / F.sum(seen)).alias("mean"))


def simplex_deviation(n: Nuisances) -> float:
    """Largest distance of the truncated mechanism's sum from one."""
    s = setting(n)
    return n.df.agg(F.max(F.abs(sum((s.g(k) for k in range(n.frame.arms)), lit(0)) - lit(1)))).first()[0]


def score_check(result: Result, gate: float = 1e-3) -> DataFrame:
    """Per parameter: is the mean curve below the gate times se / sqrt(n)?"""
    rows = [(e.name, bool(ok)) for e, ok in zip(result.estimates, result.solved(gate), strict=True)]
    return result.rows.sparkSession.createDataFrame(rows, "estimand string, solved boolean")


def weighted_auc(df: DataFrame, p: Column, y: Column, w: Column) -> float:
    """Mann-Whitney with mid-ranks: sums by score first, then one window over scores.

    Scores are summed to 10,000 ranges before the window, and only ties and order within a range are exact when
    a range holds one score; more scores than that are ordered within their range as well.
    """
    sums = df.groupBy(p.alias("p")).agg(F.sum(w * y).alias("one"), F.sum(w * (lit(1) - y)).alias("zero"))
    sums = sums.withColumn("part", F.floor(F.col("p") * 1e4))
    parts = sums.groupBy("part").agg(F.sum("zero").alias("z"))
    parts = parts.withColumn("below", F.coalesce(F.sum("z").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), lit(0))).drop("z")
    own = W.partitionBy("part").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    ranked = sums.withColumn("own", F.coalesce(F.sum("zero").over(own), lit(0))).join(parts, "part")
    r = ranked.agg(F.sum(F.col("one") * (F.col("below") + F.col("own") + F.col("zero") / 2)), F.sum("one"), F.sum("zero")).first()
    return r[0] / (r[1] * r[2]) if r[1] and r[2] else float("nan")  # one class has no order


def binary_report(df: DataFrame, p: Column, y: Column, w: Column) -> dict[str, float]:
    """AUC, Brier score, log-loss, calibration slope and means."""
    q = clip(p, 1e-12, 1 - 1e-12)
    r = df.agg(F.sum(w), F.sum(w * (y - p) ** 2), F.sum(-w * (y * F.log(q) + (lit(1) - y) * F.log(lit(1) - q))), F.sum(w * p), F.sum(w * y)).first()
    one_class = r[4] in (0, r[0])
    slope = float("nan") if one_class else LogisticNewton().fit(df, Task(y, w, binary=True), [logit(clip(p, 1e-6, 1 - 1e-6))], []).coefficients[0][1]
    return {"auc": weighted_auc(df, p, y, w), "brier": r[1] / r[0], "log_loss": r[2] / r[0], "slope": float(slope), "mean_predicted": r[3] / r[0], "mean_actual": r[4] / r[0]}


def continuous_report(df: DataFrame, p: Column, y: Column, w: Column) -> dict[str, float]:
    """Mean squared error, R2, slope of the actual on the predicted, means."""
    r = df.agg(F.sum(w), F.sum(w * (y - p) ** 2), F.sum(w * p), F.sum(w * y), F.sum(w * p * p), F.sum(w * p * y), F.sum(w * y * y)).first()
    s = r[0]
    mp, my = r[2] / s, r[3] / s
    vp, vy = r[4] / s - mp * mp, r[6] / s - my * my
    return {"mse": r[1] / s, "r2": 1 - r[1] / s / vy if vy > 1e-15 else float("nan"), "slope": (r[5] / s - mp * my) / vp if vp > 1e-15 else float("nan"), "mean_predicted": mp, "mean_actual": my}


def nuisance_report(n: Nuisances) -> DataFrame:
    """(model, metric, value) of every fitted nuisance, out of fold where it was cross-fitted."""
    f, rows = n.frame, []
    w = F.col("w")
    for k in range(1, f.arms):
        rows += [(f"g[{f.levels[k]}]", *x) for x in binary_report(n.df, F.col(f"g_{k}"), indicator(F.col("a") == k), w).items()]
    seen = n.df.where("delta = 1")
    quality = binary_report if f.family == "binomial" else continuous_report
    rows += [("q", *x) for x in quality(seen, F.col("q_obs"), F.col("ys"), w).items()]
    if f.has_delta:
        p = F.coalesce(*(F.when(F.col("a") == k, F.col(f"pi_{k}")) for k in range(f.arms)))
        rows += [("pi", *x) for x in binary_report(n.df, p, F.col("delta"), w).items()]
    return n.df.sparkSession.createDataFrame([(m, k, float(v)) for m, k, v in rows], "model string, metric string, value double")


def calibration_table(df: DataFrame, p: Column, y: Column, w: Column, bins: int | None = None) -> DataFrame:
    """(bin, n, predicted, actual) over quantile bins of the prediction."""
    rows = df.select(p.alias("p"), y.alias("y"), w.alias("w"))
    count = rows.count()
    bins = bins or min(10, max(2, count // 20))
    edges = quantiles(rows, "p", [i / bins for i in range(1, bins)], count)
    which = sum((F.when(F.col("p") > lit(e), 1).otherwise(0) for e in sorted(set(edges))), F.lit(0))
    return rows.groupBy(which.cast("int").alias("bin")).agg(F.count("*").alias("n"), (F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("predicted"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("actual"))


def truncation_curve(n: Nuisances, bounds: Sequence[float], estimand: str = "ate") -> DataFrame:
    """The estimate again at every bound, on the nuisances that are there."""
    from .point import retarget

    rows = []
    for b in bounds:
        e = retarget(n, (estimand,), g_low=b)[estimand]
        rows.append((float(b), e.psi, e.std_err))
    return n.df.sparkSession.createDataFrame(rows, "bound double, psi double, std_err double")


