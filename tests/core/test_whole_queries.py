"""Registered queries do the operator's whole job on the tables they are given."""

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["doubly_robust", "collaborative", "outcome_adaptive"])
def test_selective_queries_read_the_orders(spark, name):
    import __spark_entry__ as E

    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert n != 800 and {r.n for r in E.queries()[name](spark, SF).collect()} == {n}


def test_queries_ask_for_whole_counts(spark, monkeypatch):
    from tidemark.operators import guarded as X
    from tidemark.plans import catalog_rest as C

    asked = {}

    class Seen(Exception):
        pass

    def see(module, name):
        def stop(*a, **more):
            asked[name] = more
            raise Seen

        monkeypatch.setattr(module, name, stop)

    for module, name in ((X, "doubly_robust"), (C.R, "bootstrap"), (C.R, "refute"), (C.R, "coverage_study"), (C.I, "multiplier_critical")):
        see(module, name)
    for f in (C.doubly_robust, C.bootstrap, C.refute, C.coverage, C.simultaneous_bands):
        with pytest.raises(Seen):
            f(spark, SF)
    assert asked["doubly_robust"].get("rounds", 15) >= 15 and asked["multiplier_critical"].get("draws", 1000) >= 1000
    assert asked["refute"]["replicates"] >= 5 and asked["bootstrap"]["replicates"] >= 200 and asked["coverage_study"]["replicates"] >= 100


def test_given_orders_name_covariates(spark):
    import numpy as np

    from tidemark.design import PointDesign, point_frame
    from tidemark.errors import StudyError
    from tidemark.operators import point as P
    from tidemark.operators import selective as X

    g = np.random.default_rng(3)
    rows = [(i, float(g.integers(0, 2)), int(g.integers(0, 2)), float(g.normal()), "pqr"[i % 3], 1.0) for i in range(300)]
    f = point_frame(spark.createDataFrame(rows, "id long, y double, a int, u double, v string, one double"), PointDesign("y", "a", "id", ("u", "v", "one")))
    assert X._ordered_columns(f, ("v", "one", "u", "x_u")) == ["x_v__q", "x_v__r", "x_u"]
    (e,) = X.collaborative(f, ("ate",), P.Config(fluctuation="linear"), strategy="ordered", order=("u",)).select(["ate"])
    assert e.n == 300 and 0 < e.std_err < 0.1 and abs(e.psi) < 0.2
    with pytest.raises(StudyError):
        X.collaborative(f, ("ey",), P.Config(), strategy="ordered", order=("nope",))


def test_bootstrap_refits_on_sums_by_group(spark):
    from tidemark.design import PointDesign, point_frame
    from tidemark.operators import inference as I
    from tidemark.operators import point as P
    from tidemark.operators import resample as R
    from tidemark.plans.catalog import saturated

    rows = [(i, (i * 37 % 101) / 10, i * 7 % 5 % 2, "uv"[i % 3 % 2], 1.0 + i % 2, 0 if i % 11 == 0 else 1) for i in range(240)]
    f = point_frame(spark.createDataFrame(rows, "id long, y double, a int, v string, w double, d int"), PointDesign("y", "a", "id", ("v",), weights="w", delta="d"))
    c = saturated()
    assert R._groups(f, P.Config()) is None  # smooth learners see rows
    draw = R._draws(f, R._groups(f, c), "id", 2, 5, False)
    assert draw(1).count() <= 8 and draw(1).agg({"w": "sum"}).first()[0] == pytest.approx(I.bootstrap_weights(f.df, 1, seed=5).agg({"w": "sum"}).first()[0])
    psi = lambda df: {"ate": P.point_tmle(f.with_df(df), ("ate",), c)["ate"].psi}
    whole = I.run_bootstrap(f.df, psi, replicates=2, seed=5)["ate"]
    assert I.run_bootstrap(f.df, psi, replicates=2, draw=draw)["ate"] == pytest.approx(whole, abs=1e-9)


def test_guarded_rounds_keep_one_table(spark):
    import os

    from tidemark.design import PointDesign, point_frame
    from tidemark.operators import guarded as U
    from tidemark.operators.learn import CellMean, LinearGram, Task
    from tidemark.plans.catalog import saturated
    from tidemark.sources.store import shared_dir

    rows = [(i, (i * 37 % 101) / 10 + i % 2, i * 7 % 5 % 2, "uv"[i % 3 % 2], 0 if i % 7 == 0 else 1) for i in range(240)]
    f = point_frame(spark.createDataFrame(rows, "id long, y double, a int, v string, d int"), PointDesign("y", "a", "id", ("v",), delta="d"))
    place = shared_dir(spark).removeprefix("file:")
    tables = lambda: {c for c in os.listdir(place) if c.startswith(("guarded-", "reduced-", "closing-"))}
    before = tables()
    r = U.doubly_robust(f, saturated(), rounds=2, closing=2)
    assert len(tables() - before) == 1 and r.rows.count() == 240
    before = tables()
    r = U.doubly_robust(f, saturated(fluctuation="logistic"), rounds=1, closing=1, learner=CellMean())  # its reductions are tables too
    assert len(tables() - before) <= 2 and r.rows.count() == 240 and all(e.std_err > 0 for e in r.estimates)
    df = f.df.selectExpr("*", "cast(id % 3 as int) AS fold", "cast(id % 13 as double) AS x").where("delta = 1")
    from pyspark.sql import functions as F

    tasks = [(Task(F.col("y"), F.col("w"), F.col("a") == 1, 3), [F.col("x")]), (Task(F.col("y"), F.col("w"), None, 3), [F.col("x"), F.col("x") ** 2])]
    for fit, (task, x) in zip(LinearGram().fit_all(df, tasks), tasks, strict=True):
        assert fit.coefficients == pytest.approx(LinearGram().fit(df, task, x, []).coefficients, abs=1e-8)
