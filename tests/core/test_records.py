"""Order statistics, records, refusals, the battery, and what the driver keeps."""

import gc
import importlib
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import assessment as A
from tidemark.design import LongitudinalDesign, describe_weights, frame_from_arrays, longitudinal_frame
from tidemark.errors import CapabilityError, StudyError
from tidemark.functions.expr import lit
from tidemark.operators import diagnostics as D
from tidemark.operators import inference as I
from tidemark.operators import learn as N
from tidemark.operators import longitudinal as L
from tidemark.operators import order as O
from tidemark.operators import point as P
from tidemark.operators import selective as X
from tidemark.operators import target as T
from tidemark.phases import Phases
from tidemark.sources import generators as G

COARSE = P.Config(N.CellMean(), N.CellMean(), N.CellMean(), N.CellMean(), outcome_cells=(), fluctuation="linear")


@pytest.mark.parametrize("few", [10**6, 10])
def test_quantiles_are_exact_by_either_path(spark, monkeypatch, few):
    monkeypatch.setattr(O, "FEW_ROWS", few)
    g = np.random.default_rng(1)
    for values in (g.normal(size=3001), np.repeat([1.0, 2.0, 5.0], [10, 2000, 3]), np.array([4.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        qs = (0.0, 0.01, 0.37, 0.5, 0.99, 1.0)
        assert O.quantiles(df, "v", qs) == pytest.approx(list(np.quantile(values, qs)), abs=1e-12)
    assert all(np.isnan(O.quantiles(df.limit(0), "v", (0.5,))))


@pytest.mark.parametrize("cells", [20_000, 3])
def test_cells_gathered_or_shuffled_predict_alike(spark, monkeypatch, cells):
    monkeypatch.setattr(N, "CELL_ROWS", cells)
    df = spark.range(400).select("id", (F.col("id") % 7).alias("c"), (F.col("id") % 3).cast("int").alias("a"), (F.col("id") % 2).cast("int").alias("fold"), F.when(F.col("id") % 11 > 0, F.col("id") % 4).alias("k"), lit(1).alias("w"), F.sqrt("id").alias("y"))
    for folds in (0, 2):
        fit = N.CellMean().fit(df, N.Task(F.col("y"), F.col("w"), None, folds), [], [F.col("a"), F.col("k")])
        got = fit.predict_arms(fit.predict(df, "p", [], [F.col("a"), F.col("k")]), ["p0", "p1", "p2"], [F.col("k")]).toPandas()
        rows = df.toPandas()
        for r in got.head(60).itertuples():
            same = rows[rows.k.isna()] if np.isnan(r.k) else rows[rows.k == r.k]
            same = same if not folds else same[same.fold != r.fold]
            margin = (rows if not folds else rows[rows.fold != r.fold]).y.mean()  # where no other row is like it
            mean = lambda a: same[same.a == a].y.mean() if (same.a == a).any() else margin  # noqa: B023, E731
            assert r.p == pytest.approx(mean(r.a))
            for k in range(3):
                assert getattr(r, f"p{k}") == pytest.approx(mean(k))
    shares = N.CellMean().shares(df, F.col("a"), 3, F.col("w"), [F.col("k")], ["s0", "s1", "s2"]).agg(F.max(F.abs(F.col("s0") + F.col("s1") + F.col("s2") - 1))).first()[0]
    assert shares < 1e-12


def test_logistic_steps_by_batches_are_those_of_expressions(spark, monkeypatch):
    g = np.random.default_rng(7)
    x = g.normal(size=(300, 3))
    t = (g.random(300) < 1 / (1 + np.exp(-x @ [1.0, -0.5, 0.2]))).astype(float)
    d = spark.createDataFrame([(*map(float, r), float(y), i % 3) for i, (r, y) in enumerate(zip(x, t))], "a double, b double, c double, t double, fold int").withColumn("w", lit(1))
    for folds in (0, 3):
        found = []
        for most in (400, 0):
            monkeypatch.setattr(N, "EXPRESSION_SUMS", most)
            found.append(N.LogisticNewton().fit(d, N.Task(F.col("t"), F.col("w"), None, folds, True), [F.col(c) for c in "abc"], []).coefficients)
        assert found[0] == pytest.approx(found[1], abs=1e-9) and found[0].shape == (max(folds, 1), 4)


def arrays(spark, n=400, seed=3, **more):
    g = np.random.default_rng(seed)
    w = g.integers(0, 3, n)
    a = (g.random(n) < 0.3 + 0.15 * w).astype(int)
    y = (g.random(n) < 0.2 + 0.2 * a + 0.1 * w).astype(float)
    return frame_from_arrays(spark, y, a, w, covariate_names=("w",), **more), (w, a, y)


def test_arrays_become_a_frame_and_back(spark):
    f, (w, a, y) = arrays(spark, weights=np.linspace(0.5, 1.5, 400), cluster=np.arange(400) // 4)
    back = f.to_frame().toPandas().sort_values("id")
    assert back.y.tolist() == y.tolist() and back.a.astype(int).tolist() == a.tolist() and back.cluster.tolist() == (np.arange(400) // 4).tolist()
    assert len(f.estimand_lines()) == 2 and "effective" in f.estimand_lines()[0]
    d = describe_weights(f)
    held = np.sort(np.linspace(0.5, 1.5, 400))[::-1]
    assert d["top_1pct"] == pytest.approx(held[:4].sum() / held.sum()) and d["top_5pct"] == pytest.approx(held[:20].sum() / held.sum())
    with pytest.raises(StudyError):
        frame_from_arrays(spark, [1.0], [1, 0], [[1], [2]])


def test_overlapping_components_refuse_the_loss_weight_and_solve_without_it(spark):
    f, _ = arrays(spark)
    from dataclasses import replace

    heavy = replace(COARSE, target_weights=True, fluctuation="logistic")
    regimes = {"all": P.static(1, 2), "coin": [lit(0.7), lit(0.3)]}
    with pytest.raises(CapabilityError):
        P.regime_means(f, regimes, heavy)
    with pytest.raises(CapabilityError):
        P.msm_fit(f, P.linear_msm([0, 1]), heavy)
    with pytest.raises(CapabilityError):
        P.tilt_means(f, 2.0, heavy)
    one = P.regime_means(f, {"coin": regimes["coin"]}, heavy)
    plain = P.regime_means(f, {"coin": regimes["coin"]}, replace(heavy, target_weights=False))
    assert all(one.solved()) and one.estimates[0].psi == pytest.approx(plain.estimates[0].psi, abs=5e-3)
    assert all(P.point_tmle(f, ("ey1", "ey0"), heavy).solved())


def test_several_tilts_share_nuisances_and_contrast(spark):
    f, _ = arrays(spark)
    c = P.Config(N.CellMean(), N.CellMean())
    r = P.tilt_means(f, (1.0, 3.0), c)
    alone = P.tilt_means(f, 3.0, c)
    assert r.estimates[1].psi == pytest.approx(alone.estimates[0].psi, abs=1e-9)
    assert r["ate_ipsi[3 vs 1]"].psi == pytest.approx(r.estimates[1].psi - r.estimates[0].psi)
    gap = r.rows.agg(F.max(F.abs(F.col(r.curves[2]) - F.col(r.curves[1]) + F.col(r.curves[0])))).first()[0]
    assert gap < 1e-12 and r["ate_ipsi[3 vs 1]"].std_err ** 2 == pytest.approx(r.rows.agg(F.var_samp(r.curves[2])).first()[0] / f.n)
    for bad in ((2.0, 2.0), (0.0,), ()):
        with pytest.raises(StudyError):
            P.tilt_means(f, bad, c)


def test_groups_share_one_frame(spark):
    f, _ = arrays(spark)
    r = P.point_tmle(f, ("ey1", "att", "atc"), COARSE)
    one = [P.point_tmle(f, (e,), COARSE).estimates[0] for e in ("ey1", "att", "atc")]
    assert [(e.psi, e.std_err) for e in r.estimates] == [pytest.approx((e.psi, e.std_err)) for e in one]
    plan = r.rows.select("id", *r.curves)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join \w+, \(id#\d+L? = id#", plan)  # the groups' curves are not joined on the id


def test_records(spark):
    f, _ = arrays(spark)
    r = P.point_tmle(f, ("ey1", "ey0", "ate"), COARSE)
    assert [e.name for e in r.select(["ate", "ey1"])] == ["ate", "ey1"] and I.arm_parameters(r.estimates)["ate"] == ("1", "0")
    assert I.parameter_key(r["ate"]) == I.ParameterKey("ate", "ate", "arm", "1", "0")
    with pytest.raises(StudyError):
        r.select(["nope"])
    with pytest.raises(StudyError):
        r.coefficients()
    m = P.msm_fit(f, P.MSM(P.linear_msm([0, 1]).terms, link="logit"), P.Config(N.CellMean(), N.CellMean()))
    ratio = {x.term: x.psi for x in m.coefficients("ratio").collect()}
    assert ratio["a"] == pytest.approx(np.exp(m["msm[a]"].psi))
    spread = I.repeat_spread(spark, [r.estimates, r.estimates]).collect()
    assert all(x.spread == 0 and x.repeats == 2 for x in spread)
    halves = P.mean_parts(r.targeted["mean"], 1)
    total = r.targeted["mean"].df.agg(F.avg(sum(halves))).first()[0]
    assert total == pytest.approx(r["ey1"].psi)


def test_the_battery_finds_what_is_wrong(spark):
    f, _ = arrays(spark)
    r = P.point_tmle(f, ("ey1", "ey0", "ate"), COARSE)
    assert {x.status for x in A.validate(r).collect()} == {"passed"}
    whole = {x["check"]: x.status for x in A.run_all(r, include_retargets=True).collect()}
    assert whole["mechanisms"] == whole["simplex"] == whole["placebo"] == "skipped" and whole["truncation"] == "passed"
    r.means = r.means + 1.0
    r.estimates[0] = I.Estimate("ey1", 7.0, float("nan"), "level", f.n)
    bad = {x["check"]: x.status for x in A.validate(r).collect()}
    assert bad["finite"] == bad["scores"] == bad["ranges"] == "failed"
    assert A.replayability(r) == {"scores": True, "retarget": True, "refit": True} and A.support(r).count() == 2
    tilt = P.tilt_means(f, 2.0, P.Config(N.CellMean(), N.CellMean()))
    assert A.support(tilt).columns[0] == "tilt"


def test_one_class_and_constant_targets_give_nan(spark):
    d = spark.range(50).select((F.col("id") / 50).alias("p"), lit(1).alias("y"), lit(1).alias("w"))
    r = D.binary_report(d, F.col("p") * 0.9 + 0.05, F.col("y"), F.col("w"))
    assert np.isnan(r["auc"]) and np.isnan(r["slope"]) and r["brier"] > 0
    assert np.isnan(D.continuous_report(d, F.col("p"), F.col("y"), F.col("w"))["r2"])


class _Broken:
    def fit(self, df, task, features, cells):
        df.select("no_such_column").collect()


def test_a_candidate_that_fails_in_spark_is_dropped_by_name(spark):
    d = spark.range(60).select("id", (F.col("id") % 2).cast("double").alias("t"), (F.col("id") % 3).cast("double").alias("x"), lit(1).alias("w"))
    learner = N.SuperLearner([("broken", _Broken()), ("line", N.LinearGram())], 3, "nnls")
    with pytest.warns(UserWarning, match="broken"):
        fit = learner.fit(d, N.Task(F.col("t"), F.col("w")), [F.col("x")], [])
    assert fit.fits[0][2] == ["line"] and {r.candidate for r in fit.risk_frame(spark).collect()} == {"line", "combination"}


def test_caches_go_with_their_nuisances(spark):
    f, _ = arrays(spark)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    n = P.fit_nuisances(f, COARSE)
    n.df.count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() > before
    del n
    gc.collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_armwise_roots_and_registrations(spark):
    f, _ = arrays(spark)
    n = P.fit_nuisances(f, COARSE)
    h = [F.col("w") * 0 + 1 + F.col("q_0") * 0, lit(1)]
    eps = T.solve_armwise_mechanism(n.df, h, bounds=(0.4, 0.6))
    for k in range(2):
        g = T.tilted(F.col(f"g_{k}"), h[k], eps[k], (0.4, 0.6))
        assert abs(n.df.agg(F.avg(F.when(F.col("a") == k, 1).otherwise(0) - g)).first()[0]) < 1e-6
    with pytest.raises(StudyError):
        T.register_mechanism("ipsi", lambda d: d)


def test_collaborative_orders_and_arms(spark):
    g = np.random.default_rng(5)
    n = 500
    w = g.normal(size=(n, 3))
    a = g.integers(0, 3, n)
    a = np.where(g.random(n) < 1 / (1 + np.exp(-w[:, 0])), a, 0)
    y = 0.5 * a + w[:, 0] + 0.3 * w[:, 1] + g.normal(size=n) * 0.5
    f = frame_from_arrays(spark, y, a.tolist(), w, covariate_names=("u", "v", "z"))
    r = X.partial_correlations(f.df, F.col("y"), f.x, F.col("a").cast("double"), F.col("w"))
    assert max(r, key=lambda k: abs(r[k])) == "x_u" and abs(r["x_z"]) < 0.15
    e = X.collaborative(f, ("ey",), P.Config(fluctuation="linear"), strategy="ordered", order="partial_correlation").estimates
    assert len(e) == 3 and all(x.std_err > 0 for x in e) and 0.2 < e[1].psi - e[0].psi < 0.8
    with pytest.raises(StudyError):
        X.collaborative(f, ("ey",), P.Config(fluctuation="linear"), strategy="ordered", order="nope")


LONG = LongitudinalDesign("Y", ("A1", "A2"), ("W1",), "id", (("L2",),), ("C1", "C2"))


def test_targeted_working_models_agree_with_projection_where_they_must(spark):
    df, _ = G.longitudinal(spark, 500, seed=4)
    f = longitudinal_frame(df.withColumns({c: F.signum(c) for c in ("W1", "W2", "L2")}), LONG)
    plans = {"00": (0, 0), "10": (1, 0), "11": (1, 1)}
    s = L.Settings(coarse=True)
    cells = L.ltmle(f, plans, settings=s)
    # A term for every plan: the model holds exactly, and its coefficients are the plans' own means.
    model = L.RegimenMSM({k: lambda p, k=k: lit(float(p.label == k)) for k in plans})
    fit = L.targeted_regimen_msm(f, plans, model, settings=s)
    for a, b in zip(fit.estimates, cells.means):
        assert a.psi == pytest.approx(b.psi, abs=1e-8) and a.std_err == pytest.approx(b.std_err, abs=1e-8)
    assert np.abs(fit.means).max() < 1e-8
    with pytest.raises(StudyError):
        L.targeted_regimen_msm(f, plans, L.RegimenMSM({"1": lambda p: lit(1), "2": lambda p: lit(2)}), settings=s)
    assert {r.solved for r in cells.scores().collect()} == {True} and cells.nuisances().count() == 6
    folds = L.ltmle(f, plans, settings=L.Settings(folds=3))
    assert all(abs(a.psi - b.psi) < 4 * b.std_err for a, b in zip(folds.means, cells.means))
    assert f.baseline_frame().columns == ["id", "W1"]


def test_phases_are_timed_and_nest(spark):
    p = Phases(spark)
    with p.phase("outer"):
        with p.phase("inner"):
            spark.range(10).count()
        with p.phase("inner"):
            pass
    rows = {r.phase: r for r in p.to_frame().collect()}
    assert rows["inner"].entries == 2 and rows["outer"].seconds >= rows["inner"].seconds


def test_core_queries_stand_without_the_subpackage(monkeypatch):
    import __spark_entry__ as E

    monkeypatch.setitem(sys.modules, "tidemark.llm", None)
    monkeypatch.setitem(sys.modules, "tidemark.llm.queries", None)
    found = importlib.reload(E).queries()
    assert "ate_targeted" in found and not any(k.startswith("op") and k[2:3].isdigit() for k in found)


def test_guarded_inference_solves_every_score_and_survives_a_wrong_regression(spark):
    from dataclasses import replace

    from tidemark.operators import guarded as U

    g = np.random.default_rng(8)
    n = 3000
    w = g.integers(0, 4, n)
    a = (g.random(n) < 0.5).astype(int)
    seen = (g.random(n) < 0.9 - 0.12 * w).astype(int)
    y = 1.0 * a + 0.8 * w + g.normal(size=n)
    y = np.where(seen == 1, y, np.nan)
    f = frame_from_arrays(spark, y, a, w, covariate_names=("w",), delta=seen)
    wrong = replace(COARSE, fluctuation="linear")  # no covariate in the regression
    for frame, expected in ((f, 6), (replace(f, has_delta=False, df=f.df.where("delta = 1"), n=int(seen.sum())), 4)):
        r = U.doubly_robust(frame, wrong)
        check = U.correction_check(r).collect()
        assert len(check) == expected and all(c.solved for c in check) and all(r.solved())
    r = U.doubly_robust(f, wrong)
    assert abs(r["ate"].psi - 1.0) < 4 * r["ate"].std_err and r["ate"].psi == pytest.approx(r["ey[1]"].psi - r["ey[0]"].psi)
    half = U.doubly_robust(f, wrong, guard=("g",))
    assert set(half.corrections) == {"outcome[0]", "outcome[1]"}
    with pytest.raises(StudyError):
        U.doubly_robust(f, wrong, guard=("x",))


def test_truths_agree_with_large_samples(spark):
    n = 200_000
    df, truth = G.missing_outcome_binary(spark, n, seed=11)
    eta = lambda a: 1 / (1 + F.exp(-(lit(-0.6 + 0.9 * a) + 0.7 * F.col("W1") - 0.5 * F.col("W2") + 0.4 * F.col("W3"))))
    p1, p0 = df.agg(F.avg(eta(1)), F.avg(eta(0))).first()
    assert truth["ey1"] == pytest.approx(p1, abs=3e-3) and truth["rr"] == pytest.approx(p1 / p0, abs=1.5e-2)
    _, risks = G.longitudinal_survival(spark, 100, seed=1)
    _, kinds = G.longitudinal_survival(spark, 100, seed=1, causes=2)
    assert all(kinds[f"cif[{p}, r, t2]"] + kinds[f"cif[{p}, d, t2]"] == pytest.approx(risks[f"risk[{p}, t2]"]) and risks[f"risk[{p}, t1]"] < risks[f"risk[{p}, t2]"] for p in ("00", "11"))
    strong, truth = G.missing_outcome(spark, 2000, seed=3, strength=2.0)
    assert truth["ate"] == 1.2 and strong.where("Delta = 0 and Y is not null").isEmpty()


def test_longitudinal_estimates_find_their_truth(spark):
    df, truth = G.longitudinal(spark, 4000, seed=9)
    f = longitudinal_frame(df, LongitudinalDesign("Y", ("A1", "A2"), ("W1", "W2"), "id", (("L2",),), ("C1", "C2")))
    r = L.ltmle(f, {"11": (1, 1), "00": (0, 0)}, settings=L.Settings.smooth())
    for e in r.means:
        assert abs(e.psi - truth[f"ey[{e.arm}]"]) < 4 * e.std_err


def test_tables_come_in_many_forms(spark, tmp_path):
    import pandas as pd
    import pyarrow as pa

    from tidemark.sources.store import as_frame

    data = {"id": list(range(40)), "y": [float(i % 5) for i in range(40)], "a": [i % 2 for i in range(40)], "c": ["u" if i % 3 else "v" for i in range(40)]}
    base = spark.createDataFrame(pd.DataFrame(data))
    for kind in ("parquet", "json", "orc"):
        base.write.format(kind).save(str(tmp_path / f"t.{kind}"))
    base.write.csv(str(tmp_path / "t.csv"), header=True)
    held = [base, pd.DataFrame(data), pa.table(data), data, *(str(tmp_path / f"t.{k}") for k in ("parquet", "json", "orc", "csv"))]
    found = [P.tmle(x, spark=spark, outcome="y", treatment="a", id="id", covariates=("c",), config=COARSE)["ate"] for x in held]
    assert all((e.psi, e.std_err) == pytest.approx((found[0].psi, found[0].std_err)) for e in found) and as_frame(spark, base) is base
    with pytest.raises(ValueError):
        as_frame(spark, "t.xyz")


def test_frames_change_by_their_own_methods(spark):
    f, (w, a, y) = arrays(spark)
    half = f.subset(F.col("id") < 200)
    assert half.n == 200 and sum(half.arm_counts) == 200 and half.df.agg(F.sum("w")).first()[0] == pytest.approx(200)
    with pytest.raises(StudyError):
        f.subset(F.col("a") == 1)
    more = f.with_extra_covariate("noise", F.col("id") % 4)
    assert more.x == (*f.x, "x_noise") and more.without_covariates("noise").x == f.x
    for bad in (lambda: more.with_extra_covariate("noise", lit(1)), lambda: f.without_covariates("nope")):
        with pytest.raises(StudyError):
            bad()
    flipped = P.point_tmle(f.with_treatment(1 - F.col("a")), ("ate",), COARSE)["ate"]
    assert flipped.psi == pytest.approx(-P.point_tmle(f, ("ate",), COARSE)["ate"].psi)
    with pytest.raises(StudyError):
        frame_from_arrays(spark, [1.0] * 20, [1] + [0] * 19, list(range(20)))
    with pytest.raises(CapabilityError):
        P.fit_nuisances(f, P.Config(scheme="rolling"))
    assert P.fit_nuisances(f, P.Config(N.CellMean(), N.CellMean(), folds=5)).folds == 5


def test_learners_by_name(spark):
    f, _ = arrays(spark)
    N.register_learner("half", lambda binary: N.LinearGram(ridge=1.0), replace=True)
    a, b = (P.point_tmle(f, ("ate",), P.Config(x, "cells", fluctuation="linear"))["ate"].psi for x in ("cells", "half"))
    assert a == pytest.approx(b, abs=0.05)
    with pytest.raises(StudyError):
        N.register_learner("cells", None)
    with pytest.raises(StudyError):
        P.fit_nuisances(f, P.Config("nope"))


def test_treatments_with_labels_over_time(spark):
    df, _ = G.longitudinal(spark, 400, seed=6)
    coarse = df.withColumns({c: F.signum(c) for c in ("W1", "W2", "L2")})
    named = coarse.withColumns({c: F.when(F.col(c) == 1, "drug").when(F.col(c) == 0, "none") for c in ("A1", "A2")})
    a = L.ltmle(longitudinal_frame(coarse, LONG), {"x": (1, 0), "y": (0, 0)})
    b = L.ltmle(longitudinal_frame(named, LONG), {"x": ("none", "drug"), "y": ("drug", "drug")})
    c = L.ltmle(longitudinal_frame(named, LONG), {"x": ("drug", "none"), "y": ("none", "none")})
    assert [e.psi for e in a.means] == pytest.approx([e.psi for e in c.means]) and len(b.means) == 2
    for f, plan in ((longitudinal_frame(named, LONG), ("drug", "other")), (longitudinal_frame(coarse, LONG), ("drug", 1))):
        with pytest.raises(StudyError):
            L.ltmle(f, {"x": plan})


def test_draws_with_replacement_add_up(spark):
    df = spark.range(500).withColumns({"w": lit(1), "cl": F.floor(F.col("id") / 5)})
    a, b = I.multinomial_weights(df, 1), I.multinomial_weights(df, 2, unit="cl")
    assert a.agg(F.sum("w")).first()[0] == 500 and b.agg(F.sum("w")).first()[0] == 500
    share = a.where("w = 0").count() / 500
    assert abs(share - np.exp(-1)) < 0.08 and b.groupBy("cl").agg(F.count_distinct("w").alias("k")).where("k > 1").isEmpty()
    assert sorted(r.id for r in a.where("w > 1").collect()) == sorted(r.id for r in I.multinomial_weights(df.repartition(5), 1).where("w > 1").collect())
    assert I.map_parallel(lambda x: x * x, range(6), 3) == [0, 1, 4, 9, 16, 25]


def test_typed_methods_and_narrow_bands(spark):
    from tidemark import study as Q

    f, _ = arrays(spark)
    r = P.point_tmle(f, ("ey1", "ey0", "ate"), COARSE)
    wide, narrow = {n: h - l for n, l, h in Q.simultaneous(r)}, {n: h - l for n, l, h in Q.simultaneous(r, names=["ate"])}
    assert list(narrow) == ["ate"] and narrow["ate"] < wide["ate"]
    for bad in (lambda: Q.TMLEMethod(nope=1), lambda: Q.CollaborativeMethod(strategy="x"), lambda: Q.GuardedMethod(guard=())):
        with pytest.raises(StudyError):
            bad()
    assert Q.GuardedMethod(rounds=3).options["rounds"] == 3 and Q.CollaborativeMethod().name == "collaborative"


class _Session:
    """A session without the setting for shared folders."""

    def __init__(self, master):
        self.master, self.held = master, None
        self.conf = self.sparkContext = self

    def get(self, key, default):
        return default

    def getCheckpointDir(self):  # noqa: N802
        return self.held

    def setCheckpointDir(self, path):  # noqa: N802
        self.held = path + "/own"


def test_only_a_local_master_gets_a_folder_of_its_own():
    from tidemark.sources.store import shared_dir

    local = _Session("local[2]")
    assert shared_dir(local).startswith("file://") and shared_dir(local) == shared_dir(local)
    with pytest.raises(RuntimeError):
        shared_dir(_Session("spark://far:7077"))
