"""Exact laws, identities, refusals and partition independence of the point engine."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.design import PointDesign, point_frame
from tidemark.errors import CapabilityError, StudyError
from tidemark.functions.expr import lit
from tidemark.operators import covariate as C
from tidemark.operators import point as P
from tidemark.operators.folds import split_clusters, with_folds
from tidemark.operators.inference import bh_adjust, covariance, multiplier_critical, normal_critical
from tidemark.operators.learn import CellMean, LinearGram, LogisticNewton, SuperLearner, Task, nnls, screen, t_two_sided
from tidemark.operators.target import relative, scores

SAT = P.Config(CellMean(), CellMean(), CellMean(), CellMean(), fluctuation="linear")
COARSE = P.Config(CellMean(), CellMean(), CellMean(), CellMean(), outcome_cells=(), fluctuation="linear")


def law(spark):
    """1000 rows whose empirical law is the population law: three cells of W, binary A and Y."""
    rows, i = [], 0
    for w, share, g, q in ((0, 500, 0.4, (0.4, 0.7)), (1, 300, 0.6, (0.2, 0.5)), (2, 200, 0.25, (0.6, 0.8))):
        for a in (0, 1):
            n = round(share * (g if a else 1 - g))
            ones = round(n * q[a])
            for k in range(n):
                rows.append((i, w, a, int(k < ones), i // 5))
                i += 1
    return spark.createDataFrame(rows, "id long, W int, A int, Y int, cl long")


def frame(spark, df=None, **roles):
    df = (law(spark) if df is None else df).withColumn("W", F.col("W").cast("string"))
    return point_frame(df, PointDesign(**({"outcome": "Y", "treatment": "A", "id": "id", "covariates": ("W",)} | roles)))


def test_closed_form_truth_of_the_exact_law(spark):
    f = frame(spark)
    r = P.point_tmle(f, ("ey1", "ey0", "ate", "rr", "att", "atc", "paf"), COARSE)
    assert r["ey1"].psi == pytest.approx(0.66, abs=1e-12) and r["ey0"].psi == pytest.approx(0.38, abs=1e-12)
    assert r["ate"].psi == pytest.approx(0.28) and r["rr"].psi == pytest.approx(0.66 / 0.38)
    sat = P.point_tmle(f, ("att", "atc"), SAT)
    assert sat["att"].psi == pytest.approx(0.124 / 0.43) and sat["atc"].psi == pytest.approx(0.156 / 0.57)
    assert all(r.solved())


def test_targeting_moves_a_coarse_regression_and_not_a_saturated_one(spark):
    f = frame(spark)
    moved = P.target(P.fit_nuisances(f, COARSE), "mean")
    still = P.target(P.fit_nuisances(f, SAT), "mean")
    assert abs(moved.fluctuation.epsilon).max() > 1e-3 and abs(still.fluctuation.epsilon).max() < 1e-12
    assert relative(scores(moved.df, P.residual(moved), [c.observed for c in moved.components], F.col("w"))) < 1e-9


def test_logistic_fluctuation_solves_its_score_and_agrees_in_the_saturated_case(spark):
    f = frame(spark)
    lo = P.point_tmle(f, ("ate",), P.Config(CellMean(), CellMean(), outcome_cells=()))
    assert lo["ate"].psi == pytest.approx(0.28, abs=1e-8) and all(lo.solved())
    one = P.point_tmle(f, ("ate",), P.Config(CellMean(), CellMean(), outcome_cells=(), algorithm="one_step"))
    assert one["ate"].psi == pytest.approx(lo["ate"].psi, abs=2e-3)


def test_identities(spark):
    f = frame(spark)
    n = P.fit_nuisances(f, COARSE)
    r = P.point_tmle(f, ("ey1", "ey0", "ate", "ey_obs", "par"), nuisances=n)
    gap = r.rows.agg(F.max(F.abs(F.col(r.curves[2]) - F.col(r.curves[0]) + F.col(r.curves[1])))).first()[0]
    assert gap < 1e-12 and r["par"].psi == pytest.approx(r["ey_obs"].psi - r["ey0"].psi)
    reg = P.regime_means(f, {"one": P.static(1, 2), "zero": P.static(0, 2)}, nuisances=n)
    assert reg.estimates[0].psi == pytest.approx(r["ey1"].psi) and reg.estimates[0].std_err == pytest.approx(r["ey1"].std_err)
    msm = P.msm_fit(f, P.linear_msm([0, 1]), nuisances=n)
    assert msm["msm[a]"].psi == pytest.approx(r["ate"].psi) and msm["msm[a]"].std_err == pytest.approx(r["ate"].std_err)
    tilt = P.tilt_means(f, 1.0, P.Config(CellMean(), CellMean()))
    assert tilt.estimates[0].psi == pytest.approx(r["ey_obs"].psi, abs=1e-6)


def test_clusters_covariance_and_partitions(spark):
    f = frame(spark, cluster="cl")
    a = P.point_tmle(f, ("ey1", "ey0", "ate"), COARSE)
    b = P.point_tmle(frame(spark, law(spark).repartition(7), cluster="cl"), ("ey1", "ey0", "ate"), COARSE)
    for x, y in zip(a.estimates, b.estimates):
        assert x.psi == pytest.approx(y.psi, abs=1e-10) and x.std_err == pytest.approx(y.std_err, abs=1e-10)
    sums = a.rows.groupBy("cluster").agg(F.sum(a.curves[2]).alias("v")).agg(F.count("*"), F.var_samp("v")).first()
    assert a["ate"].std_err == pytest.approx(math.sqrt(sums[0] * sums[1]) / 1000)
    assert a.cov[2, 2] == pytest.approx(a.cov[0, 0] + a.cov[1, 1] - 2 * a.cov[0, 1])


def test_folds_keep_clusters_whole_and_no_row_trains_itself(spark):
    df = law(spark)
    assert split_clusters(with_folds(df, 5, cluster="cl"), "cl").isEmpty()
    assert split_clusters(with_folds(df, 5, cluster="cl", stratify="A"), "cl").isEmpty()
    counts = [r["count"] for r in with_folds(df, 5, stratify="A").groupBy("A", "fold").count().collect()]
    assert max(counts) - min(counts) <= 1000
    d = with_folds(df.withColumn("v", F.col("id").cast("double")), 2).withColumn("w", lit(1))
    fit = CellMean().fit(d, Task(F.col("v"), F.col("w"), None, 2), [], [F.col("W")])
    got = fit.predict(d, "m", [], [F.col("W")]).groupBy("W", "fold").agg(F.first("m").alias("m"))
    own = d.groupBy("W", "fold").agg(F.avg("v").alias("a"))
    both = {(r.W, r.fold): r for r in got.join(own, ["W", "fold"]).collect()}
    for (w, v), r in both.items():
        assert r.m == pytest.approx(both[w, 1 - v].a)


def test_learners_agree_with_closed_forms(spark):
    d = law(spark).withColumn("w", lit(1)).withColumn("t", F.col("A").cast("double"))
    b = LinearGram().fit(d, Task(F.col("Y").cast("double"), F.col("w")), [F.col("t")], []).coefficients[0]
    means = {r.A: r.m for r in d.groupBy("A").agg(F.avg("Y").alias("m")).collect()}
    assert b[0] == pytest.approx(means[0]) and b[0] + b[1] == pytest.approx(means[1])
    g = LogisticNewton().fit(d, Task(F.col("Y").cast("double"), F.col("w")), [F.col("t")], []).coefficients[0]
    assert g[0] == pytest.approx(math.log(means[0] / (1 - means[0])), abs=1e-6)
    import numpy as np

    assert nnls(np.array([[2.0, 0], [0, 1]]), np.array([1.0, -1])).tolist() == [0.5, 0.0]
    assert t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6) and t_two_sided(0, 5) == pytest.approx(1)
    s = SuperLearner([("cells", CellMean()), ("line", LinearGram())], inner_folds=3, loss="nnls")
    fit = s.fit(d, Task(F.col("Y").cast("double"), F.col("w")), [F.col("t")], [F.col("A"), F.col("W")])
    assert fit.fits[0][0].sum() == pytest.approx(1) and fit.fits[0][0][0] > 0.5
    assert screen(d.withColumn("u", (F.col("id") % 7).cast("double")), F.col("Y").cast("double"), ["t", "u"], F.col("w"), 1000, min_retain=1) == ["t"]


def test_bands_and_adjustment(spark):
    r = P.point_tmle(frame(spark), ("ey1", "ey0", "ate"), COARSE)
    z = normal_critical(r.cov)
    m = multiplier_critical(r.rows, r.curves, [e.std_err for e in r.estimates], draws=400)
    assert 1.96 < z < 2.6 and abs(z - m) < 0.35
    adjusted = {x.k: x.p_adjusted for x in bh_adjust(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double"), "p", "k").collect()}
    assert adjusted["a"] == pytest.approx(0.03) and adjusted["b"] == adjusted["c"] == pytest.approx(0.04)
    assert covariance(r.rows, r.curves)[2] == 1000


def test_refusals(spark):
    f = frame(spark)
    for wanted, error in ((("nope",), StudyError), (("ey2",), StudyError)):
        with pytest.raises(error):
            P.point_tmle(f, wanted, SAT)
    with pytest.raises(CapabilityError):
        P.point_tmle(frame(spark, law(spark).withColumn("Y", F.col("Y") * 2.5)), ("rr",), SAT)
    with pytest.raises(CapabilityError):
        P.point_tmle(frame(spark, law(spark).withColumn("d", lit(1)), delta="d"), ("par",), SAT)
    with pytest.raises(CapabilityError):
        P.tilt_means(f, 2.0, P.Config(g_low=0.05))
    with pytest.raises(StudyError):
        P.regime_means(f, {"bad": [lit(0.5), lit(0.4)]}, SAT)
    with pytest.raises(StudyError):
        frame(spark, law(spark).withColumn("id", lit(1)))
    with pytest.raises(StudyError):
        frame(spark, law(spark).withColumn("Y", F.when(F.col("id") > 3, F.col("Y"))))
    with pytest.raises(CapabilityError):
        frame(spark, law(spark).withColumn("k", lit(2)), weights="k", weights_type="frequency")
    with pytest.raises(StudyError):
        C.register_group("mean", lambda s: [])
