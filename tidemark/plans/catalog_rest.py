"""Queries over doses, resampling, selection and stored results, and over data with known truth."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from .. import study as Q
from ..design import LongitudinalDesign, PointDesign, longitudinal_frame, point_frame
from ..functions.expr import lit
from ..operators import dose as O
from ..operators import guarded as U
from ..operators import inference as I
from ..operators import learn as N
from ..operators import longitudinal as L
from ..operators import point as P
from ..operators import resample as R
from ..operators import selective as X
from ..operators import sensitivity as V
from ..operators.folds import hash32
from ..sources import generators as G
from ..sources import store
from . import sql as S
from .catalog import _study, orders, query, saturated, shown


def lines(spark, sf_dir):
    """Line items whose discount is a dose with eleven values.

    The table has no unique key: ids are digests of whole rows, which single-group fits never join on, and need not be unique.
    """
    li = store.table(spark, sf_dir, "lineitem")
    return li.select(F.xxhash64(*li.columns).alias("id"), F.round(F.col("l_discount") * 100).cast("double").alias("dose"), (F.col("l_extendedprice") / lit(1000)).alias("y"), F.concat("l_returnflag", "l_linestatus").alias("cell"), F.col("l_orderkey").alias("cl"))


_EDGES = [k - 0.5 for k in range(12)]

_SHIFT = """d AS (SELECT l_orderkey * 8 + l_linenumber AS id, CAST(round(l_discount * 100) AS DOUBLE) AS a, l_extendedprice / 1e3 AS y, l_returnflag || l_linestatus AS cell FROM lineitem),
k AS (SELECT cell, a, count(*) * 1e0 AS nca FROM d GROUP BY cell, a),
c0 AS (SELECT cell, count(*) * 1e0 AS nc FROM d GROUP BY cell),
q AS (SELECT a, avg(y) AS q FROM d GROUP BY a),
x AS (SELECT d.*, CASE WHEN a + 1 > 10 THEN a ELSE a + 1 END AS b FROM d),
r AS (SELECT x.*, q.q AS qo, q2.q AS qb,
  (CASE WHEN x.a <= 10 THEN coalesce(k1.nca, 0e0) / k0.nca ELSE 0e0 END) + (CASE WHEN x.a > 9 THEN 1e0 ELSE 0e0 END) AS h,
  (CASE WHEN x.b <= 10 THEN coalesce(k3.nca, 0e0) / k2.nca ELSE 0e0 END) + (CASE WHEN x.b > 9 THEN 1e0 ELSE 0e0 END) AS hb
  FROM x JOIN q ON q.a = x.a JOIN q q2 ON q2.a = x.b JOIN k k0 ON k0.cell = x.cell AND k0.a = x.a LEFT JOIN k k1 ON k1.cell = x.cell AND k1.a = x.a - 1
  JOIN k k2 ON k2.cell = x.cell AND k2.a = x.b LEFT JOIN k k3 ON k3.cell = x.cell AND k3.a = x.b - 1),
e AS (SELECT sum(h * (y - qo)) / sum(h * h) AS eps FROM r),
t AS (SELECT r.*, qo + eps * h AS so, qb + eps * hb AS sb FROM r, e),
m AS (SELECT avg(sb) AS psi FROM t),
c AS (SELECT t.*, psi, h * (y - so) + sb - psi AS ic FROM t, m)"""


@query("dose_shift", S.query(_SHIFT, final=S.report([("ey_shift[up]", "psi", "ic", "level")])))
def dose_shift(spark, sf_dir):
    """Everyone's discount one step up, but for those at the top: saturated hazards and outcome means by dose."""
    f = point_frame(lines(spark, sf_dir).drop("cl"), PointDesign("y", "dose", "id", ("cell",), treatment_kind="continuous", check_ids=False))
    c = P.Config(N.CellMean(), N.CellMean(), fluctuation="linear")
    r = O.shift_means(f, {"up": O.Shift(1.0, 10.0)}, c, edges=_EDGES, outcome_features=lambda a: ([a], [a]))
    return shown(spark, r.estimates)


@query("density", S.query(_SHIFT.split(",\nq AS")[0], final="SELECT cell, CAST(a AS INTEGER) AS bin, round(nca / nc, 6) AS p FROM k JOIN c0 USING (cell)"))
def density(spark, sf_dir):
    """Conditional probabilities of the dose's bins by cell, from pooled hazards."""
    df = lines(spark, sf_dir).withColumn("a", F.col("dose")).withColumn("w", lit(1))
    out, _ = O.fit_density(df, [], [F.col("cell")], learner=N.CellMean(), edges=_EDGES)
    p = out.groupBy("cell").agg(F.first("p_bin").alias("p_bin"))
    return p.select("cell", F.posexplode("p_bin").alias("bin", "p")).select("cell", "bin", F.round("p", 6).alias("p"))


@query("shift_support")
def shift_support(spark, sf_dir):
    df = lines(spark, sf_dir).withColumn("a", F.col("dose")).withColumn("w", lit(1))
    out, d = O.fit_density(df, [], [F.col("cell")], learner=N.CellMean(), edges=_EDGES)
    r = O.shift_support(out, d, {"up": O.Shift(1.0, 10.0), "far": O.Shift(20.0)})
    return r.select("shift", F.round("max_ratio", 6).alias("max_ratio"), F.round("effective_n", 3).alias("effective_n"), *(F.round(c, 6).alias(c) for c in ("out_of_support", "crossing")))


@query("screening", S.query(S.base("f"), "z AS (SELECT *, CAST(h2 AS DOUBLE) AS u FROM (SELECT d.*, (('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8))::BIGINT) % 97 AS h2 FROM d))", final="SELECT 'a' AS name, round(corr(CAST(a AS DOUBLE), y), 6) AS r FROM z UNION ALL SELECT 'u', round(corr(u, y), 6) FROM z"))
def screening(spark, sf_dir):
    """Correlations that a screen works on, from one aggregate."""
    df = orders(spark, sf_dir).withColumns({"u": (F.col("h") % 97).cast("double"), "a": F.col("a").cast("double"), "w": lit(1)})
    r = N.correlations(df, F.col("f"), ["a", "u"], F.col("w"))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in r.items()], "name string, r double")


@query("super_learner")
def super_learner(spark, sf_dir):
    """A convex combination of cell means, a line and a logistic model as the outcome regression."""
    library = [("cells", N.CellMean()), ("line", N.LinearGram()), ("logistic", N.LogisticNewton())]
    c = P.Config(N.SuperLearner(library, 3, "nnls"), N.LogisticNewton(), fluctuation="linear")
    return shown(spark, P.point_tmle(_study(orders(spark, sf_dir), outcome="f"), ("ate",), c).estimates)


@query("flexible_learners")
def flexible_learners(spark, sf_dir):
    """Boosting, a forest, a lasso and a linear model, combined for the outcome; learners are given by name."""
    f = point_frame(*_selectable(spark, sf_dir))
    return shown(spark, P.point_tmle(f, ("ate",), P.Config("super", "glm", fluctuation="linear")).estimates)


@query("mllib_learner")
def mllib_learner(spark, sf_dir):
    from pyspark.ml.regression import DecisionTreeRegressor

    c = P.Config(N.MLlib(DecisionTreeRegressor(maxDepth=3, seed=1)), N.LogisticNewton(), fluctuation="linear")
    return shown(spark, P.point_tmle(_study(orders(spark, sf_dir)), ("ate",), c).estimates)


@query("simultaneous_bands")
def simultaneous_bands(spark, sf_dir):
    r = P.point_tmle(_study(orders(spark, sf_dir)), ("ey1", "ey0", "ate"), saturated())
    m = I.multiplier_critical(r.rows, r.curves, [e.std_err for e in r.estimates])
    rows = [(kind, n, lo, hi) for kind, z in (("normal", I.normal_critical(r.cov)), ("rademacher", m)) for n, lo, hi in I.bands(r.estimates, z)]
    return spark.createDataFrame(rows, "kind string, estimand string, lower double, upper double")


@query("bootstrap")
def bootstrap(spark, sf_dir):
    b = R.bootstrap(_study(orders(spark, sf_dir)), "ate", saturated(), replicates=200)
    return spark.createDataFrame([(k, float(v)) for k, v in b.items()], "what string, value double")


@query("refute")
def refute(spark, sf_dir):
    return R.refute(_study(orders(spark, sf_dir)), saturated(), replicates=5)


@query("importance")
def importance(spark, sf_dir):
    df = orders(spark, sf_dir).withColumns({"odd": (F.col("h") % 2).cast("int"), "urgent": F.col("a")})
    return R.variable_importance(df, "y", ("urgent", "odd"), ("seg",), saturated())


def _selectable(spark, sf_dir):
    """The orders study with numeric covariates, among which a treatment model can choose."""
    o, c = store.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), store.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    df = orders(spark, sf_dir).join(o, F.col("id") == F.col("o_orderkey")).join(c, F.col("cl") == F.col("c_custkey"))
    df = df.withColumns({"balance": F.col("c_acctbal") / lit(1000), "day": F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")) / lit(1000), "building": F.when(F.col("seg") == "BUILDING", lit(1)).otherwise(lit(0))})
    return df.select("id", "y", "a", *_W), PointDesign("y", "a", "id", _W)


_W = ("balance", "day", "building")


@query("collaborative")
def collaborative(spark, sf_dir):
    study = Q.CausalStudy(*_selectable(spark, sf_dir))
    return shown(spark, study.identify(Q.ATE()).estimate("collaborative", strategy="ordered").estimates)


@query("collaborative_arms")
def collaborative_arms(spark, sf_dir):
    """A given order for five arms, scored by the likelihood of a binary outcome."""
    df, design = _selectable(spark, sf_dir)
    arms = orders(spark, sf_dir).select("id", "priority", "f")
    f = point_frame(df.drop("y", "a").join(arms, "id"), replace(design, outcome="f", treatment="priority", covariates=("balance", "building")))
    return shown(spark, X.collaborative(f, ("ey",), P.Config(), strategy="ordered", order=("balance",), loss="likelihood").estimates)


@query("partial_correlations", f"WITH {S.ORDERS}, x AS (SELECT d0.y, CAST(d0.a AS DOUBLE) AS a, c_acctbal / 1e3 AS b, CASE WHEN seg = 'BUILDING' THEN 1e0 ELSE 0e0 END AS s FROM d0 JOIN customer ON cl = c_custkey), c AS (SELECT corr(y, a) AS ya, corr(y, b) AS yb, corr(a, b) AS ab, corr(y, s) AS ys, corr(a, s) AS sa FROM x) SELECT 'balance' AS name, round((yb - ab * ya) / sqrt((1e0 - ab * ab) * (1e0 - ya * ya)), 6) AS r FROM c UNION ALL SELECT 'building', round((ys - sa * ya) / sqrt((1e0 - sa * sa) * (1e0 - ya * ya)), 6) FROM c")
def partial_correlations(spark, sf_dir):
    """What an order of covariates goes by: correlations with the outcome given the treatment."""
    df, _ = _selectable(spark, sf_dir)
    r = X.partial_correlations(df.withColumn("w", lit(1)), F.col("y"), ["balance", "building"], F.col("a").cast("double"), F.col("w"))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in r.items()], "name string, r double")


@query("outcome_adaptive")
def outcome_adaptive(spark, sf_dir):
    f = point_frame(*_selectable(spark, sf_dir))
    return shown(spark, X.collaborative(f, ("ate",), P.Config(), strategy="outcome_adaptive").estimates)


@query("doubly_robust")
def doubly_robust(spark, sf_dir):
    f = point_frame(*_selectable(spark, sf_dir))
    return shown(spark, U.doubly_robust(f, P.Config()).estimates)


@query("doubly_robust_missing")
def doubly_robust_missing(spark, sf_dir):
    """A quarter of the outcomes missing: both mechanisms and the regression are guarded."""
    df, design = _selectable(spark, sf_dir)
    df = df.withColumn("delta", F.when(hash32(F.col("id")) % 4 == 0, 0).otherwise(1))
    f = point_frame(df, replace(design, delta="delta"))
    return shown(spark, U.doubly_robust(f, P.Config(fluctuation="linear")).estimates)


@query("correction_check", " UNION ALL ".join(f"SELECT '{n}[{k}]' AS correction, TRUE AS solved" for k in (0, 1) for n in ("treatment", "outcome")))
def correction_check(spark, sf_dir):
    f = point_frame(*_selectable(spark, sf_dir))
    return U.correction_check(U.doubly_robust(f, P.Config(fluctuation="linear"))).select("correction", "solved")


@query("known_truth")
def known_truth(spark, sf_dir):
    """(study, estimand, psi, std_err, truth) of smooth fits on generated data."""
    rows = []
    for name, make, wanted, roles in (
        ("linear", G.linear_ate, "ate", {}),
        ("missing", G.missing_outcome, "ate", {"delta": "Delta"}),
        ("clustered", G.clustered, "ate", {"cluster": "cluster"}),
        ("biased", G.biased_sample, "ate", {"weights": "sampling_weight"}),
    ):
        df, truth = make(spark, 2000, seed=1)
        w = tuple(c for c in df.columns if c.startswith("W"))
        e = P.point_tmle(point_frame(df, PointDesign("Y", "A", "id", w, **roles)), ("ate",), P.Config())[wanted]
        rows.append((name, wanted, e.psi, e.std_err, truth[wanted]))
    return spark.createDataFrame(rows, "study string, estimand string, psi double, std_err double, truth double")


@query("coverage")
def coverage(spark, sf_dir):
    def draw(b):
        df, truth = G.linear_ate(spark, 400, seed=b)
        return df, truth["ate"]

    fit = lambda df: P.point_tmle(point_frame(df, PointDesign("Y", "A", "id", ("W1", "W2", "W3", "W4"))), ("ate",), P.Config(fluctuation="linear"))["ate"]
    return R.summarize(R.coverage_study(spark, draw, fit, replicates=100))


@query("stored_result")
def stored_result(spark, sf_dir):
    """Estimates after a round trip through Parquet and JSON."""
    r = P.point_tmle(_study(orders(spark, sf_dir)), ("ate",), saturated())
    path = f"{store.shared_dir(spark)}/result-{uuid.uuid4().hex}"
    store.save_result(r, path, fingerprint=store.fingerprint(r.influence_frame().select("id")))
    return store.load_result(spark, path)["estimates"].select("estimand", F.round("psi", 6).alias("psi"), F.round("std_err", 6).alias("std_err"))


@query("study_api", S.query(S.base(), S.nuisances(2), S.linear_means(2), S.curves(2), final=S.report(S.arm_rows(("ate",)))))
def study_api(spark, sf_dir):
    """The question layer, from declared roles to the estimate."""
    df = orders(spark, sf_dir).select("id", "y", "a", "seg")
    effect = Q.CausalStudy(df, PointDesign("y", "a", "id", ("seg",))).identify(Q.ATE())
    return shown(spark, effect.estimate(Q.Method("tmle", saturated())).estimates)


@query(
    "fold_report",
    S.query(S.base(folds=5), S.nuisances(2, folds=5, q_cells=("seg",)), S.linear_means_by_fold(2), final="SELECT fold::INTEGER AS fold, count(*)::BIGINT AS n, round(sum(w * s0) / sum(w), 6) AS ey_0, round(sum(w * s1) / sum(w), 6) AS ey_1 FROM t GROUP BY fold"),
)
def fold_report(spark, sf_dir):
    """The folds' own targeted arm means."""
    c = P.Config(N.CellMean(), N.CellMean(), folds=5, stratify=False, fluctuation="linear", fold_targeting=True)
    r = P.fold_evaluated(P.fit_nuisances(_study(orders(spark, sf_dir)), c))
    return r.select("fold", "n", *(F.round(f"ey_{k}", 6).alias(f"ey_{k}") for k in (0, 1)))


@query("repeats")
def repeats(spark, sf_dir):
    """Three cross-fits by other seeds, averaged: mean estimates, and the variance of the mean curve."""
    f = _study(orders(spark, sf_dir))
    runs = [P.point_tmle(f, ("ey1", "ey0", "ate"), P.Config(N.CellMean(), N.CellMean(), folds=5, seed=s, stratify=False, fluctuation="linear")) for s in range(3)]
    rows = None
    for i, r in enumerate(runs):
        part = r.rows.select("id", *(F.col(c).alias(f"r{i}_{j}") for j, c in enumerate(r.curves)))
        rows = part if rows is None else rows.join(part, "id")
    mean = rows.select("id", *((sum(F.col(f"r{i}_{j}") for i in range(3)) / lit(3)).alias(f"m{j}") for j in range(3)))
    _, cov, _ = I.covariance(mean, ["m0", "m1", "m2"])
    return shown(spark, I.average_repeats([r.estimates for r in runs], cov))


@query("tipping_point")
def tipping_point(spark, sf_dir):
    """The smallest odds factor of unobserved outcomes at which the contrast vanishes."""
    df = orders(spark, sf_dir).withColumn("delta", F.when(F.col("h") % 4 == 0, 0).otherwise(1))
    n = P.fit_nuisances(_study(df, delta="delta", outcome="f"), saturated())
    gamma = V.tipping_gamma(n, P.target(n, "mean"), arm_gamma=(0.0, 1.0))
    return spark.createDataFrame([(round(gamma, 6),)], "gamma double")


@query("strength_benchmark")
def strength_benchmark(spark, sf_dir):
    """How strong a confounder the market segment is: a fit with and one without it."""
    df = orders(spark, sf_dir).withColumn("k", (F.col("h") % 3).cast("string"))

    def fit(w):
        n = P.fit_nuisances(_study(df, covariates=w), P.Config(N.CellMean(), N.CellMean(), fluctuation="linear"))
        return V.elements(n, P.target(n, "mean"))

    b = V.benchmark(fit(("seg", "k")), fit(("k",)))
    return spark.createDataFrame([tuple(round(float(b[k]), d) for k, d in (("cf_y", 6), ("cf_d", 6), ("rho", 4), ("change", 6)))], "cf_y double, cf_d double, rho double, change double")


@query("weighted_fluctuation")
def weighted_fluctuation(spark, sf_dir):
    """The covariate's size moved into the loss weight: the same score, another path."""
    return shown(spark, P.point_tmle(_study(orders(spark, sf_dir)), ("ey1", "ey0", "ate"), saturated(fluctuation="logistic", target_weights=True)).estimates)


@query("truth_survival")
def truth_survival(spark, sf_dir):
    """Risk and competing incidences of generated studies with censoring."""
    plans = {"always": (1, 1), "never": (0, 0)}
    one, _ = G.longitudinal_survival(spark, 800, seed=6)
    two, _ = G.longitudinal_survival(spark, 800, seed=6, causes=2)
    coarse = lambda d: d.withColumns({c: F.signum(c) for c in ("W1", "W2", "L2")})
    roles = {"treatment": ("A1", "A2"), "baseline": ("W1",), "id": "id", "time_varying": (("L2",),), "censoring": ("C1", "C2")}
    a = L.ltmle(longitudinal_frame(coarse(one), LongitudinalDesign(outcome=("Y1", "Y2"), **roles)), plans)
    b = L.ltmle(longitudinal_frame(coarse(two), LongitudinalDesign(outcome={"r": ("R1", "R2"), "d": ("D1", "D2")}, **roles)), plans)
    return shown(spark, a.means + b.means)


@query("row_fingerprint")
def row_fingerprint(spark, sf_dir):
    df = orders(spark, sf_dir).select("id", hash32(F.col("id")).alias("h"))
    return spark.createDataFrame([(store.fingerprint(df),)], "fingerprint string")
