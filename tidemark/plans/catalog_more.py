"""The rest of the registered queries: regimes, models, diagnostics, sensitivity and longitudinal studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..design import LongitudinalDesign, arm_fractions, describe_weights, longitudinal_frame
from ..functions.expr import indicator, lit
from ..operators import covariate as C
from ..operators import diagnostics as D
from ..operators import inference as I
from ..operators import longitudinal as L
from ..operators import point as P
from ..operators import sensitivity as V
from ..operators.folds import with_folds
from ..operators.learn import CellMean
from ..sources.store import table
from . import sql as S
from .catalog import _PRIORITIES, _study, orders, query, saturated, shown

# Regimes: everyone treated, a rule by segment, and a known coin.

_REG = {"all": ("0e0", "1e0"), "rule": ("CASE WHEN seg = 'BUILDING' THEN 0e0 ELSE 1e0 END", "CASE WHEN seg = 'BUILDING' THEN 1e0 ELSE 0e0 END"), "coin": ("0.7e0", "0.3e0")}


def _regimes():
    inside = F.col("c_seg") == "BUILDING"
    return {"all": P.static(1, 2), "rule": P.rule(F.when(inside, 1).otherwise(0), 2), "coin": [lit(0.7), lit(0.3)]}


def _regime_sql() -> str:
    r = list(_REG.items())
    h = ", ".join(f"({d0}) * p0 AS h{i}_0, ({d1}) * p1 AS h{i}_1, ({d0}) AS f{i}_0, ({d1}) AS f{i}_1" for i, (_, (d0, d1)) in enumerate(r))
    ho = ", ".join(f"CASE a WHEN 1 THEN h{i}_1 ELSE h{i}_0 END AS o{i}" for i in range(3))
    g = ", ".join(f"sum(w * o{i} * o{j}) AS g{i}{j}" for i in range(3) for j in range(i, 3))
    b = ", ".join(f"sum(w * o{i} * (y - qo)) AS b{i}" for i in range(3))
    det = "(g00 * (g11 * g22 - g12 * g12) - g01 * (g01 * g22 - g12 * g02) + g02 * (g01 * g12 - g11 * g02))"
    e0 = f"(b0 * (g11 * g22 - g12 * g12) - g01 * (b1 * g22 - g12 * b2) + g02 * (b1 * g12 - g11 * b2)) / {det} AS e0"
    e1 = f"(g00 * (b1 * g22 - g12 * b2) - b0 * (g01 * g22 - g12 * g02) + g02 * (g01 * b2 - b1 * g02)) / {det} AS e1"
    e2 = f"(g00 * (g11 * b2 - b1 * g12) - g01 * (g01 * b2 - b1 * g02) + b0 * (g01 * g12 - g11 * g02)) / {det} AS e2"
    s = ", ".join(f"q{k} + " + " + ".join(f"e{i} * h{i}_{k}" for i in range(3)) + f" AS s{k}" for k in (0, 1))
    m = ", ".join(f"sum(w * (f{i}_0 * s0 + f{i}_1 * s1)) / sum(w) AS m{i}" for i in range(3))
    d = ", ".join(f"w * (o{i} * (y - so) + f{i}_0 * s0 + f{i}_1 * s1 - m{i}) AS d{i}" for i in range(3))
    rows = [(f"ey_regime[{n}]", f"m{i}", f"d{i}", "level") for i, (n, _) in enumerate(r)]
    rows += [(f"ate_regime[{n} vs all]", f"m{i} - m0", f"d{i} - d0", "difference") for i, (n, _) in enumerate(r) if i]
    return S.query(
        S.base(), S.nuisances(2), f"r0 AS (SELECT *, {h} FROM u)", f"r1 AS (SELECT *, {ho} FROM r0)", f"r2 AS (SELECT {g}, {b} FROM r1)", f"r3 AS (SELECT {e0}, {e1}, {e2} FROM r2)",
        f"r4 AS (SELECT r1.*, {s}, qo + e0 * o0 + e1 * o1 + e2 * o2 AS so FROM r1, r3)", f"r5 AS (SELECT {m} FROM r4)", f"c AS (SELECT r4.*, {', '.join(f'm{i}' for i in range(3))}, {d} FROM r4, r5)", final=S.report(rows),
    )


@query("regimes", _regime_sql())
def regimes(spark, sf_dir):
    """Means under a static, a dynamic and a stochastic regime: three score equations at once."""
    return shown(spark, P.regime_means(_study(orders(spark, sf_dir)), _regimes(), saturated()).estimates)


@query("regime_support", S.query(S.base(), S.nuisances(2), "h AS (SELECT *, CASE a WHEN 1 THEN (CASE WHEN seg = 'BUILDING' THEN 1e0 ELSE 0e0 END) / g1 ELSE (CASE WHEN seg = 'BUILDING' THEN 0e0 ELSE 1e0 END) / g0 END AS r, CASE WHEN seg = 'BUILDING' THEN g1 ELSE g0 END AS m FROM (SELECT *, 1e0 - g1 AS gz FROM u))", final="SELECT 'rule' AS regime, round(min(m), 6) AS min_g, round(max(r), 6) AS max_ratio, round(quantile_cont(r, 0.99), 6) AS ratio_q99, round(sum(w * r) * sum(w * r) / sum(w * r * w * r), 4) AS effective_n, sum(CASE WHEN m <= 0 THEN 1 ELSE 0 END)::BIGINT AS unsupported FROM h"))
def regime_support(spark, sf_dir):
    n = P.fit_nuisances(_study(orders(spark, sf_dir)), saturated())
    s = C.check_support(n.df, {"rule": _regimes()["rule"]}, 2)
    return s.select("regime", *(F.round(c, 6).alias(c) for c in ("min_g", "max_ratio", "ratio_q99")), F.round("effective_n", 4).alias("effective_n"), F.col("unsupported").cast("long").alias("unsupported"))


@query("odds_tilt")
def odds_tilt(spark, sf_dir):
    """The mean when the odds of treatment are doubled: outcome and mechanism equations solved in turn."""
    return shown(spark, P.tilt_means(_study(orders(spark, sf_dir), outcome="f"), 2.0, saturated(fluctuation="logistic")).estimates)


# Marginal structural models over the five priorities, dosed 0 to 4.


def _msm_sql() -> str:
    ks = range(5)
    h0 = " ".join(f"WHEN {k} THEN p{k}" for k in ks)
    h1 = " ".join(f"WHEN {k} THEN {k} * p{k}" for k in ks)
    s = ", ".join(f"q{k} + e0 * p{k} + e1 * {k} * p{k} AS s{k}" for k in ks)
    plug0 = " + ".join(f"s{k}" for k in ks)
    plug1 = " + ".join(f"{k} * s{k}" for k in ks)
    # M = [[5, 10], [10, 30]] for weights one, so its inverse is [[0.6, -0.2], [-0.2, 0.1]].
    return S.query(
        S.base(a="CASE priority " + " ".join(f"WHEN '{v}' THEN {k}" for k, v in enumerate(_PRIORITIES)) + " END"), S.nuisances(5),
        f"x AS (SELECT *, CASE a {h0} END AS o0, CASE a {h1} END AS o1 FROM u)",
        "g AS (SELECT sum(w * o0 * o0) AS g00, sum(w * o0 * o1) AS g01, sum(w * o1 * o1) AS g11, sum(w * o0 * (y - qo)) AS b0, sum(w * o1 * (y - qo)) AS b1 FROM x)",
        "e AS (SELECT (b0 * g11 - b1 * g01) / (g00 * g11 - g01 * g01) AS e0, (g00 * b1 - g01 * b0) / (g00 * g11 - g01 * g01) AS e1 FROM g)",
        f"t AS (SELECT x.*, {s}, qo + e0 * o0 + e1 * o1 AS so FROM x, e)",
        f"m AS (SELECT sum(w * ({plug0})) / sum(w) AS r0, sum(w * ({plug1})) / sum(w) AS r1 FROM t)",
        "b AS (SELECT 0.6e0 * r0 - 0.2e0 * r1 AS beta0, -0.2e0 * r0 + 0.1e0 * r1 AS beta1 FROM m)",
        f"i AS (SELECT t.*, beta0, beta1, w * (o0 * (y - so) + {plug0} - 5 * beta0 - 10 * beta1) AS i0, w * (o1 * (y - so) + {plug1} - 10 * beta0 - 30 * beta1) AS i1 FROM t, b)",
        "c AS (SELECT *, 0.6e0 * i0 - 0.2e0 * i1 AS d0, -0.2e0 * i0 + 0.1e0 * i1 AS d1 FROM i)",
        final=S.report([("msm[1]", "beta0", "d0", "level"), ("msm[a]", "beta1", "d1", "level")]),
    )


@query("msm_linear", _msm_sql())
def msm_linear(spark, sf_dir):
    """A line through the five arm means, by one two-equation targeting."""
    return shown(spark, P.msm_fit(_study(orders(spark, sf_dir), treatment="priority"), P.linear_msm([0, 1, 2, 3, 4]), saturated()).estimates)


@query("msm_logit")
def msm_logit(spark, sf_dir):
    """A logistic working model: targeting and projection alternate."""
    model = P.MSM(P.linear_msm([0, 1, 2, 3, 4]).terms, link="logit")
    return shown(spark, P.msm_fit(_study(orders(spark, sf_dir), treatment="priority", outcome="f"), model, saturated(), rounds=4).estimates)


_STRATA = "('FURNITURE', 'MACHINERY')"


@query(
    "strata",
    S.query(
        S.base(s=f"CASE WHEN seg IN {_STRATA} THEN 'goods' ELSE 'other' END"), S.nuisances(2),
        "e AS (SELECT s, sum(CASE WHEN a = 1 THEN w * p1 * (y - qo) ELSE 0e0 END) / sum(CASE WHEN a = 1 THEN w * p1 * p1 ELSE 0e0 END) AS e1, sum(CASE WHEN a = 0 THEN w * p0 * (y - qo) ELSE 0e0 END) / sum(CASE WHEN a = 0 THEN w * p0 * p0 ELSE 0e0 END) AS e0, sum(w) AS sw FROM u GROUP BY s)",
        "t AS (SELECT u.*, sw, q1 + e1 * p1 AS s1, q0 + e0 * p0 AS s0, CASE a WHEN 1 THEN qo + e1 * p1 ELSE qo + e0 * p0 END AS so FROM u JOIN e USING (s))",
        "m AS (SELECT s, sum(w * s1) / sum(w) AS m1, sum(w * s0) / sum(w) AS m0 FROM t GROUP BY s)",
        "c AS (SELECT t.*, m1 - m0 AS psi, n / sw * w * (CASE WHEN a = 1 THEN p1 ELSE -p0 END * (y - so) + s1 - s0 - (m1 - m0)) AS ic FROM t JOIN m USING (s))",
        "z AS (SELECT s.s, psi, CASE WHEN c.s = s.s THEN ic ELSE 0e0 END AS ic FROM c, (SELECT DISTINCT s, psi AS p2 FROM c) s)",
        "k AS (SELECT s, any_value(psi) AS unused, sqrt(var_samp(ic) / count(*)) AS se, count(*)::BIGINT AS n FROM z GROUP BY s)",
        "f AS (SELECT k.s, k.se, k.n, (SELECT any_value(psi) FROM c WHERE c.s = k.s) AS psi FROM k)",
        final=f"SELECT 'ate[1 vs 0]|' || s AS estimand, round(psi, 6) AS psi, round(se, 6) AS std_err, round(psi - {S.Z975} * se, 6) AS ci_lower, round(psi + {S.Z975} * se, 6) AS ci_upper, n FROM f",
    ),
)
def strata(spark, sf_dir):
    """The contrast within two groups of segments, from one fluctuation with a block per stratum."""
    df = orders(spark, sf_dir).withColumn("grp", F.when(F.col("seg").isin("FURNITURE", "MACHINERY"), "goods").otherwise("other"))
    f = _study(df, covariates=("seg", "grp"), strata=("grp",))
    return shown(spark, P.strata_params(P.fit_nuisances(f, saturated())).estimates)


# Folds, weights, overlap and the quality of nuisances.


@query("fold_counts", S.query(S.base(folds=5), final="SELECT fold::INTEGER AS fold, count(*)::BIGINT AS n, sum(a)::BIGINT AS treated FROM d GROUP BY fold"))
def fold_counts(spark, sf_dir):
    return with_folds(orders(spark, sf_dir), 5).groupBy("fold").agg(F.count("*").alias("n"), F.sum("a").alias("treated"))


@query("stratified_folds", S.query(S.base(), "r AS (SELECT a, (row_number() OVER (PARTITION BY a ORDER BY ('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8))::BIGINT, id) - 1) % 5 AS fold FROM d)", final="SELECT fold::INTEGER AS fold, a::INTEGER AS a, count(*)::BIGINT AS n FROM r GROUP BY ALL"))
def stratified_folds(spark, sf_dir):
    return with_folds(orders(spark, sf_dir), 5, stratify="a").groupBy("fold", "a").agg(F.count("*").alias("n"))


@query("arm_fractions", S.query(S.base(a="priority", w="0.7e0 * (1 + id % 3)"), final="SELECT a AS level, round(sum(w) / any_value(n), 6) AS fraction FROM d GROUP BY a"))
def arm_fractions_query(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("w0", lit(0.7) * (1 + F.col("id") % 3))
    return arm_fractions(_study(df, treatment="priority", weights="w0")).select("level", F.round("fraction", 6).alias("fraction"))


@query(
    "weight_report",
    S.query(
        S.base(w="0.7e0 * (1 + id % 3)"), "r AS (SELECT *, row_number() OVER (ORDER BY w DESC) AS i FROM d)",
        final="SELECT round(any_value(neff), 4) AS effective_n, round(stddev_pop(w) / avg(w), 6) AS cv, round(max(w) / avg(w), 6) AS max_over_mean, round(sum(CASE WHEN i <= ceil(0.01e0 * n) THEN w ELSE 0e0 END) / sum(w), 6) AS top_1pct, round(sum(CASE WHEN i <= ceil(0.05e0 * n) THEN w ELSE 0e0 END) / sum(w), 6) AS top_5pct FROM r",
    ),
)
def weight_report(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("w0", lit(0.7) * (1 + F.col("id") % 3))
    r = describe_weights(_study(df, weights="w0"))
    return spark.createDataFrame([(round(r["effective_n"], 4), *(round(r[k], 6) for k in ("cv", "max_over_mean", "top_1pct", "top_5pct")))], "effective_n double, cv double, max_over_mean double, top_1pct double, top_5pct double")


@query(
    "positivity",
    S.query(
        S.base(), S.nuisances(2), "v AS (SELECT '1' AS arm, g1 AS g, w * CASE WHEN a = 1 THEN 1e0 ELSE 0e0 END / b1 AS v FROM u UNION ALL SELECT '0', 1e0 - g1, w * CASE WHEN a = 0 THEN 1e0 ELSE 0e0 END / b0 FROM u)",
        final="SELECT arm, round(min(g), 6) AS q0, round(quantile_cont(g, 0.25), 6) AS q25, round(quantile_cont(g, 0.5), 6) AS q5, round(max(g), 6) AS q1, round(sum(v) * sum(v) / sum(v * v), 4) AS effective_n, round(max(v) / sum(v), 8) AS top_share FROM v GROUP BY arm",
    ),
)
def positivity(spark, sf_dir):
    r = D.positivity(P.fit_nuisances(_study(orders(spark, sf_dir)), saturated()))
    return r.select("arm", *(F.round(c, 6).alias(c) for c in ("q0", "q25", "q5", "q1")), F.round("effective_n", 4).alias("effective_n"), F.round("top_share", 8).alias("top_share"))


@query(
    "propensity_quality",
    S.query(
        S.base(), S.nuisances(2),
        "k AS (SELECT g1 AS p, sum(CASE WHEN a = 1 THEN w ELSE 0e0 END) AS one, sum(CASE WHEN a = 0 THEN w ELSE 0e0 END) AS zero FROM u GROUP BY g1)",
        "r AS (SELECT *, coalesce(sum(zero) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS below FROM k)",
        "q AS (SELECT sum(one * (below + zero / 2)) / (sum(one) * sum(zero)) AS auc FROM r)",
        final="SELECT round(any_value(auc), 6) AS auc, round(sum(w * (a - g1) * (a - g1)) / sum(w), 6) AS brier, round(sum(-w * (a * ln(g1) + (1 - a) * ln(1e0 - g1))) / sum(w), 6) AS log_loss FROM u, q",
    ),
)
def propensity_quality(spark, sf_dir):
    n = P.fit_nuisances(_study(orders(spark, sf_dir)), saturated())
    # Cell means of equal cells agree in all digits here, so ties are ties in either engine.
    r = D.binary_report(n.df, F.col("g_1"), indicator(F.col("a") == 1), F.col("w"))
    return spark.createDataFrame([tuple(round(r[k], 6) for k in ("auc", "brier", "log_loss"))], "auc double, brier double, log_loss double")


@query("calibration", S.query(S.base(), S.nuisances(2), "b AS (SELECT *, CASE WHEN g1 > (SELECT quantile_cont(g1, 0.5) FROM u) THEN 1 ELSE 0 END AS bin FROM u)", final="SELECT bin::INTEGER AS bin, count(*)::BIGINT AS n, round(sum(w * g1) / sum(w), 6) AS predicted, round(sum(w * a) / sum(w), 6) AS actual FROM b GROUP BY bin"))
def calibration(spark, sf_dir):
    n = P.fit_nuisances(_study(orders(spark, sf_dir)), saturated())
    r = D.calibration_table(n.df, F.col("g_1"), indicator(F.col("a") == 1), F.col("w"), bins=2)
    return r.select("bin", "n", F.round("predicted", 6).alias("predicted"), F.round("actual", 6).alias("actual"))


@query("nuisance_report")
def nuisance_report(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("delta", F.when(F.col("h") % 4 == 0, 0).otherwise(1))
    n = P.fit_nuisances(_study(df, delta="delta", outcome="f"), P.Config(CellMean(), CellMean(), CellMean(), folds=5, stratify=False))
    return D.nuisance_report(n).withColumn("value", F.round("value", 5))


def _bounded(b: float) -> str:
    return S.query(S.base(), S.nuisances(2, low=f"{b}e0"), S.linear_means(2), S.curves(2), final=f"SELECT {b}e0 AS bound, round(any_value(m1 - m0), 6) AS psi, round(sqrt(var_samp(d1 - d0) / count(*)), 6) AS std_err FROM c")


@query("truncation_curve", " UNION ALL ".join(f"SELECT * FROM ({_bounded(b)})" for b in (0.01, 0.38, 0.42)))
def truncation_curve(spark, sf_dir):
    n = P.fit_nuisances(_study(orders(spark, sf_dir)), saturated())
    return D.truncation_curve(n, (0.01, 0.38, 0.42)).select("bound", F.round("psi", 6).alias("psi"), F.round("std_err", 6).alias("std_err"))


@query("scores_solved", S.query(S.base(), S.nuisances(2), S.linear_means(2), S.curves(2), final=" UNION ALL ".join(f"SELECT '{n}' AS estimand, abs(avg({d})) <= 1e-3 * sqrt(var_samp({d}) / count(*)) / sqrt(count(*)) + 1e-12 AS solved FROM c" for n, d in (("ey1", "d1"), ("ey0", "d0"), ("ate", "d1 - d0")))))
def scores_solved(spark, sf_dir):
    return D.score_check(P.point_tmle(_study(orders(spark, sf_dir)), ("ey1", "ey0", "ate"), saturated()))


@query("covariance", S.query(S.base(), S.nuisances(2), S.linear_means(2), S.curves(2), final="SELECT round(covar_samp(d1, d0) / count(*), 8) AS cov_10, round(var_samp(d1) / count(*), 8) AS var_1, round(var_samp(d0) / count(*), 8) AS var_0 FROM c"))
def covariance(spark, sf_dir):
    r = P.point_tmle(_study(orders(spark, sf_dir)), ("ey1", "ey0"), saturated())
    return spark.createDataFrame([(round(float(r.cov[0, 1]), 8), round(float(r.cov[0, 0]), 8), round(float(r.cov[1, 1]), 8))], "cov_10 double, var_1 double, var_0 double")


@query("contrast", S.query(S.base("f"), S.nuisances(2), S.linear_means(2), S.curves(2), final=S.report([("nnt", "1e0 / (m1 - m0)", "-(d1 - d0) / ((m1 - m0) * (m1 - m0))", "difference")])))
def contrast(spark, sf_dir):
    """A user's smooth function of reported means, here the number needed to treat, by the delta method."""
    r = P.point_tmle(_study(orders(spark, sf_dir), outcome="f"), ("ey1", "ey0"), saturated())
    gap = r["ey1"].psi - r["ey0"].psi
    return shown(spark, [I.smooth_contrast(lambda v: 1 / (v[0] - v[1]), r.estimates, r.cov, name="nnt", gradient=[-1 / gap**2, 1 / gap**2])])


# Sensitivity.

_OV = S.query(
    S.base(), S.nuisances(2), S.linear_means(2), S.curves(2),
    "r AS (SELECT *, CASE a WHEN 1 THEN p1 ELSE -p0 END AS ho, y - so AS r FROM c)",
    "k AS (SELECT sum(w * r * r) / sum(w) AS s2, sum(w * (2 * (p1 + p0) - ho * ho)) / sum(w) AS n2, any_value(m1 - m0) AS psi FROM r)",
    "x AS (SELECT d1 - d0 AS a, (s2 * w * (2 * (p1 + p0) - ho * ho - n2) + n2 * w * (r * r - s2)) / (2 * sqrt(s2 * n2)) AS b FROM r, k)",
    "v AS (SELECT var_samp(a) / count(*) AS vaa, covar_samp(a, b) / count(*) AS vab, var_samp(b) / count(*) AS vbb FROM x)",
    "z AS (SELECT psi, s2, n2, sqrt(s2 * n2) AS bias, sqrt(0.03e0 * 0.03e0 / 0.97e0) AS s, vaa, vab, vbb FROM k, v)",
    final="SELECT round(s2, 4) AS sigma2, round(n2, 6) AS nu2, round(psi - s * bias, 6) AS theta_lower, round(psi + s * bias, 6) AS theta_upper, round(psi - s * bias - 1.6448536269514722e0 * sqrt(vaa - 2 * s * vab + s * s * vbb), 5) AS ci_lower, round(psi + s * bias + 1.6448536269514722e0 * sqrt(vaa + 2 * s * vab + s * s * vbb), 5) AS ci_upper FROM z",
)


def _elements(spark, sf_dir, **roles):
    n = P.fit_nuisances(_study(orders(spark, sf_dir), **roles), saturated())
    return n, V.elements(n, P.target(n, "mean"))


@query("omitted_variable", _OV)
def omitted_variable(spark, sf_dir):
    """Bounds under an unmeasured confounder of strength 0.03 with outcome and treatment."""
    _, e = _elements(spark, sf_dir)
    b = V.omitted_variable_bounds(e)
    return spark.createDataFrame([(round(e.sigma2, 4), round(e.nu2, 6), round(b["theta_lower"], 6), round(b["theta_upper"], 6), round(b["ci_lower"], 5), round(b["ci_upper"], 5))], "sigma2 double, nu2 double, theta_lower double, theta_upper double, ci_lower double, ci_upper double")


@query("bias_contour", S.query(_OV[5:].split("\nSELECT round(s2")[0], final="SELECT round(i * 0.015e0, 6) AS cf_d, round(j * 0.015e0, 6) AS cf_y, round(psi - sqrt(i * 0.015e0 * j * 0.015e0 / (1e0 - i * 0.015e0)) * bias, 5) AS theta_lower, round(psi + sqrt(i * 0.015e0 * j * 0.015e0 / (1e0 - i * 0.015e0)) * bias, 5) AS theta_upper FROM z, range(11) a(i), range(11) b(j)"))
def bias_contour(spark, sf_dir):
    _, e = _elements(spark, sf_dir)
    return V.contour(spark, e).select(F.round("cf_d", 6).alias("cf_d"), F.round("cf_y", 6).alias("cf_y"), F.round("theta_lower", 5).alias("theta_lower"), F.round("theta_upper", 5).alias("theta_upper"))


@query("robustness")
def robustness(spark, sf_dir):
    _, e = _elements(spark, sf_dir)
    return spark.createDataFrame([(round(V.robustness_value(e), 6), round(V.robustness_value(e, level=0.95), 6))], "rv double, rv_level double")


_E = "CASE WHEN x < 1e0 THEN 1e0 / x ELSE x END"


@query("evalues", S.query(S.base("f"), S.nuisances(2), S.linear_means(2), S.curves(2), "k AS (SELECT any_value(m1 / m0) AS rr, sqrt(var_samp(d1 / m1 - d0 / m0) / count(*)) AS se FROM c)", f"i AS (SELECT rr AS x, 'evalue' AS what FROM k UNION ALL SELECT CASE WHEN rr >= 1 THEN greatest(exp(ln(rr) - {S.Z975} * se), 1e0) ELSE least(exp(ln(rr) + {S.Z975} * se), 1e0) END, 'evalue_ci' FROM k)", final=f"SELECT what, round({_E} + sqrt(({_E}) * ({_E} - 1e0)), 6) AS value FROM i"))
def evalues(spark, sf_dir):
    r = P.point_tmle(_study(orders(spark, sf_dir), outcome="f"), ("rr",), saturated())
    return spark.createDataFrame([(k, round(v, 6)) for k, v in V.evalue(r["rr"]).items()], "what string, value double")


_GAMMAS = (-2.0, -1.0, 0.0, 1.0, 2.0)


@query(
    "missingness_tilt",
    S.query(
        S.base("f", delta="CASE WHEN h % 4 = 0 THEN 0 ELSE 1 END"), S.nuisances(2, delta=True), S.linear_means(2),
        final="SELECT gamma, round(sum(w * (pi1 * s1 + (1e0 - pi1) / (1e0 + exp(-(ln(s1 / (1e0 - s1)) + gamma))) - pi0 * s0 - (1e0 - pi0) / (1e0 + exp(-(ln(s0 / (1e0 - s0)) + gamma))))) / sum(w), 6) AS ate FROM t, (VALUES (-2e0), (-1e0), (0e0), (1e0), (2e0)) v(gamma) GROUP BY gamma",
    ),
)
def missingness_tilt(spark, sf_dir):
    """The contrast if unobserved outcomes differed from observed ones by an odds factor."""
    df = orders(spark, sf_dir).withColumn("delta", F.when(F.col("h") % 4 == 0, 0).otherwise(1))
    n = P.fit_nuisances(_study(df, delta="delta", outcome="f"), saturated())
    return V.missingness_tilt(n, P.target(n, "mean"), _GAMMAS).select("gamma", F.round("ate", 6).alias("ate"))


# Longitudinal: per user two windows; A = any click, L = any view in the first window, C = still active.


def visits(spark, sf_dir):
    """One row per user: W, A1, C1, L2, A2, C2, Y, and events by window for survival and competing causes."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    mid = F.lit("2024-01-16").cast("timestamp")
    e = e.withColumn("t", F.when(F.col("ts") < mid, 1).otherwise(2))
    any_ = lambda c: F.max(F.when(c, 1).otherwise(0))
    is_ = lambda kind, t: (F.col("event_type") == kind) & (F.col("t") == t)
    u = e.groupBy("user_id").agg(
        F.sum(F.when(F.col("t") == 1, 1).otherwise(0)).alias("k1"), F.sum(F.when(is_("click", 1), 1).otherwise(0)).alias("clicks1"), F.sum(F.when(is_("click", 2), 1).otherwise(0)).alias("clicks2"),
        F.sum(F.when(is_("purchase", 1), 1).otherwise(0)).alias("buys1"), F.sum(F.when(is_("purchase", 2), 1).otherwise(0)).alias("buys2"), F.sum(F.when(is_("error", 1), 1).otherwise(0)).alias("errors1"), F.sum(F.when(is_("error", 2), 1).otherwise(0)).alias("errors2"), any_(F.col("t") == 2).alias("later"),
    )
    odd = lambda c: (F.col(c) % 2).cast("double")
    c1, c2 = (F.col("user_id") % 7 != 3), (F.col("user_id") % 7 != 3) & (F.col("user_id") % 11 != 5)
    e1, x1 = (F.col("buys1") % 4 == 1), (F.col("errors1") % 4 == 1) & (F.col("buys1") % 4 != 1)
    e2, x2 = e1 | ((F.col("buys2") % 3 == 1) & ~x1), x1 | ((F.col("errors2") % 3 == 1) & (F.col("buys2") % 3 != 1) & ~e1)
    num = lambda c: F.when(c, lit(1)).otherwise(lit(0))
    return u.select(
        "user_id", (F.col("k1") % 3).cast("double").alias("W"), odd("clicks1").alias("A1"), num(c1).alias("C1"), F.when(c1, odd("buys1")).alias("L2"), F.when(c1, odd("clicks2")).alias("A2"), num(c2).alias("C2"),
        F.when(c2, (F.col("buys2") + F.col("clicks2")).cast("double")).alias("Y"), num(e1 & c1).alias("E1"), num(c2 & e2 | (e1 & c1)).alias("E2"), num(x1 & c1).alias("X1"), num(c2 & x2 | (x1 & c1)).alias("X2"),
    )


_VISITS = """e AS (SELECT user_id, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END AS t, event_type FROM events),
g AS (SELECT user_id, sum(CASE WHEN t = 1 THEN 1 ELSE 0 END) AS k1, {sums} FROM e GROUP BY user_id),
v0 AS (SELECT *, user_id % 7 <> 3 AS k_c1, user_id % 7 <> 3 AND user_id % 11 <> 5 AS k_c2, buys1 % 4 = 1 AS e1, errors1 % 4 = 1 AND buys1 % 4 <> 1 AS x1 FROM g),
v1 AS (SELECT *, e1 OR (buys2 % 3 = 1 AND NOT x1) AS e2, x1 OR (errors2 % 3 = 1 AND buys2 % 3 <> 1 AND NOT e1) AS x2 FROM v0),
v AS (SELECT user_id, CAST(k1 % 3 AS DOUBLE) AS w0, CAST(clicks1 % 2 AS DOUBLE) AS a1, k_c1 AS c1, CASE WHEN k_c1 THEN CAST(buys1 % 2 AS DOUBLE) END AS l2, CASE WHEN k_c1 THEN CAST(clicks2 % 2 AS DOUBLE) END AS a2, k_c2 AS c2,
  CASE WHEN k_c2 THEN CAST(buys2 + clicks2 AS DOUBLE) END AS y, e1 AND k_c1 AS ev1, (k_c2 AND e2) OR (e1 AND k_c1) AS ev2, x1 AND k_c1 AS xv1, (k_c2 AND x2) OR (x1 AND k_c1) AS xv2 FROM v1)""".format(
    sums=", ".join(f"sum(CASE WHEN event_type = '{k}' AND t = {t} THEN 1 ELSE 0 END) AS {n}{t}" for k, n in (("click", "clicks"), ("purchase", "buys"), ("error", "errors")) for t in (1, 2))
)


def _mech(arm: int, absorbing: str = "FALSE") -> str:
    """Mechanism along the static plan of one arm: cell means by (w0) and (w0, l2, a1), cumulated and bounded."""
    return f"""m{arm}a AS (SELECT *, avg(CASE WHEN a1 = {arm} THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY w0) AS g1 FROM v),
m{arm}b AS (SELECT *, sum(CASE WHEN a1 = {arm} AND c1 THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY w0) / nullif(sum(CASE WHEN a1 = {arm} THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY w0), 0) AS h1, c1 AND NOT ({absorbing}) AS live FROM m{arm}a),
m{arm}c AS (SELECT *, sum(CASE WHEN live AND a1 = {arm} AND a2 = {arm} THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY w0, coalesce(l2, 0)) / nullif(sum(CASE WHEN live AND a1 = {arm} THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY w0, coalesce(l2, 0)), 0) AS g2,
  sum(CASE WHEN live AND a1 = {arm} AND a2 = {arm} AND c2 THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY w0, coalesce(l2, 0)) / nullif(sum(CASE WHEN live AND a1 = {arm} AND a2 = {arm} THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY w0, coalesce(l2, 0)), 0) AS h2 FROM m{arm}b),
m{arm} AS (SELECT *, least(greatest(g1 * h1, 0.01e0), 1e0) AS k1, least(greatest(g1 * h1 * coalesce(g2, 0) * coalesce(h2, 0), 0.01e0), 1e0) AS k2,
  a1 = {arm} AND c1 AS f1, live AND a1 = {arm} AND coalesce(a2 = {arm}, FALSE) AND c2 AS f2, live AND a1 = {arm} AS r2 FROM m{arm}c)"""


def _recursion(arm: int, tag: str, end: str, now1: str | None, stop1: str = "FALSE") -> str:
    """Two backward steps with intercept-only regressions and linear fluctuations: table t{tag}.

    ``end`` is the last pseudo-outcome; in survival ``now1`` is the event at time 1 and ``stop1`` any event then.
    """
    first = "s2" if now1 is None else f"CASE WHEN {now1} THEN 1e0 ELSE 0e0 END + CASE WHEN {stop1} THEN 0e0 ELSE 1e0 END * coalesce(s2, 0.5e0)"
    return f"""n{tag} AS (SELECT *, CASE WHEN f2 THEN {end} END AS z2 FROM m{arm}),
n{tag}q AS (SELECT avg(z2) AS q2, sum(CASE WHEN f2 THEN (z2 - (SELECT avg(z2) FROM n{tag})) / k2 END) / sum(CASE WHEN f2 THEN 1e0 / k2 END) AS e2 FROM n{tag}),
o{tag} AS (SELECT n.*, CASE WHEN r2 THEN q2 + e2 END AS s2 FROM n{tag} n, n{tag}q),
o{tag}z AS (SELECT *, CASE WHEN f1 THEN {first} END AS z1 FROM o{tag}),
o{tag}q AS (SELECT avg(z1) AS q1, sum(CASE WHEN f1 THEN (z1 - (SELECT avg(z1) FROM o{tag}z)) / k1 END) / sum(CASE WHEN f1 THEN 1e0 / k1 END) AS e1 FROM o{tag}z),
t{tag} AS (SELECT user_id, q1 + e1 AS psi, coalesce((z1 - (q1 + e1)) / k1, 0e0) + coalesce((z2 - s2) / k2, 0e0) AS ic FROM o{tag}z, o{tag}q)"""


def _pair(names: tuple[str, str], stem: str) -> str:
    return f"p AS (SELECT a.psi AS m1, b.psi AS m0, a.ic AS d1, b.ic AS d0 FROM t1 a JOIN t0 b USING (user_id))"


_PLANS = {"always": (1, 1), "never": (0, 0)}


def _mean_frame(spark, sf_dir):
    return longitudinal_frame(visits(spark, sf_dir), LongitudinalDesign("Y", ("A1", "A2"), ("W",), "user_id", (("L2",),), ("C1", "C2")))


@query("ltmle_mean", S.query(_VISITS, _mech(1), _mech(0), _recursion(1, "1", "y", None), _recursion(0, "0", "y", None), _pair(("always", "never"), "ey"), final=S.report([("ey_regimen[always]", "m1", "d1", "level"), ("ey_regimen[never]", "m0", "d0", "level"), ("ate_regimen[never vs always]", "m0 - m1", "d0 - d1", "difference")], table="p")))
def ltmle_mean(spark, sf_dir):
    """Mean outcome under always and never, with coarse regressions so that both fluctuations move."""
    r = L.ltmle(_mean_frame(spark, sf_dir), _PLANS, settings=L.Settings(coarse=True))
    return shown(spark, r.means + r.contrasts)


def _survival_frame(spark, sf_dir):
    return longitudinal_frame(visits(spark, sf_dir), LongitudinalDesign(("E1", "E2"), ("A1", "A2"), ("W",), "user_id", (("L2",),), ("C1", "C2")))


_SURV = S.query(_VISITS, _mech(1, "ev1"), _mech(0, "ev1"), _recursion(1, "1", "CASE WHEN ev2 THEN 1e0 ELSE 0e0 END", "ev1", "ev1"), _recursion(0, "0", "CASE WHEN ev2 THEN 1e0 ELSE 0e0 END", "ev1", "ev1"), _pair(("always", "never"), "risk"), final=S.report([("risk_regimen[always, t2]", "m1", "d1", "level"), ("risk_regimen[never, t2]", "m0", "d0", "level"), ("ate_regimen[never vs always, t2]", "m0 - m1", "d0 - d1", "difference")], table="p"))


@query("ltmle_survival", _SURV)
def ltmle_survival(spark, sf_dir):
    """Risk of a first purchase by the second window."""
    r = L.ltmle(_survival_frame(spark, sf_dir), _PLANS, settings=L.Settings(coarse=True))
    return shown(spark, r.means + r.contrasts)


def _competing_frame(spark, sf_dir):
    return longitudinal_frame(visits(spark, sf_dir), LongitudinalDesign({"purchase": ("E1", "E2"), "error": ("X1", "X2")}, ("A1", "A2"), ("W",), "user_id", (("L2",),), ("C1", "C2")))


def _cause(x: str) -> tuple[str, str]:
    return f"CASE WHEN {x}v2 THEN 1e0 ELSE 0e0 END", f"{x}v1"


@query(
    "ltmle_competing",
    S.query(
        _VISITS, _mech(1, "ev1 OR xv1"), _mech(0, "ev1 OR xv1"), *(_recursion(arm, f"{x}{arm}", *_cause(x), "ev1 OR xv1") for x in "ex" for arm in (1, 0)),
        "p AS (SELECT a.psi AS e1, a.ic AS de1, b.psi AS e0, b.ic AS de0, c.psi AS x1, c.ic AS dx1, d.psi AS x0, d.ic AS dx0 FROM te1 a JOIN te0 b USING (user_id) JOIN tx1 c USING (user_id) JOIN tx0 d USING (user_id))",
        final=S.report([("cif_regimen[always, purchase, t2]", "e1", "de1", "level"), ("cif_regimen[always, error, t2]", "x1", "dx1", "level"), ("cif_regimen[never, purchase, t2]", "e0", "de0", "level"), ("cif_regimen[never, error, t2]", "x0", "dx0", "level")], table="p"),
    ),
)
def ltmle_competing(spark, sf_dir):
    """Cumulative incidence of purchases and of errors as competing first events."""
    return shown(spark, L.ltmle(_competing_frame(spark, sf_dir), _PLANS, settings=L.Settings(coarse=True)).means)


@query("survival_curve")
def survival_curve(spark, sf_dir):
    return L.ltmle(_survival_frame(spark, sf_dir), _PLANS, horizons=(1, 2)).curve("survival").select("regimen", "cause", "horizon", *(F.round(c, 6).alias(c) for c in ("value", "lower", "upper")))


@query("incidence_total")
def incidence_total(spark, sf_dir):
    r = L.ltmle(_competing_frame(spark, sf_dir), _PLANS).incidence_total()
    return r.select("regimen", "horizon", *(F.round(c, 6).alias(c) for c in ("total", "std_err", "excess")))


@query(
    "stagewise",
    S.query(_VISITS, _mech(1), final="SELECT 'always' AS regimen, 1::INTEGER AS time, count(*)::BIGINT AS at_risk, sum(CASE WHEN f1 THEN 1 ELSE 0 END)::BIGINT AS following, round(max(CASE WHEN f1 THEN 1e0 / k1 END), 6) AS max_weight FROM m1 UNION ALL SELECT 'always', 2, sum(CASE WHEN r2 THEN 1 ELSE 0 END)::BIGINT, sum(CASE WHEN f2 THEN 1 ELSE 0 END)::BIGINT, round(max(CASE WHEN f2 THEN 1e0 / k2 END), 6) FROM m1"),
)
def stagewise(spark, sf_dir):
    r = L.ltmle(_mean_frame(spark, sf_dir), {"always": (1, 1)}, settings=L.Settings(coarse=True)).stagewise()
    return r.select("regimen", "time", "at_risk", "following", F.round("max_weight", 6).alias("max_weight"))


@query("ltmle_smooth")
def ltmle_smooth(spark, sf_dir):
    """Logistic and linear regressions, a logistic fluctuation, and a rule that reads the history."""
    plans = [L.Regimen("always", (1, 1)), L.Regimen("if_bought", (1, lambda: F.coalesce(F.col("l_1_L2"), lit(0))))]
    r = L.ltmle(_mean_frame(spark, sf_dir), plans, settings=L.Settings.smooth())
    return shown(spark, r.means + r.contrasts)


@query("regimen_msm")
def regimen_msm(spark, sf_dir):
    r = L.ltmle(_mean_frame(spark, sf_dir), {"00": (0, 0), "10": (1, 0), "11": (1, 1)})
    return shown(spark, L.regimen_msm(r, {"1": lambda c: 1.0, "treated": lambda c: float(c.label.count("1"))}))
