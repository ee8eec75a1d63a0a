"""Queries over longitudinal cross-fits, targeted working models, several tilts, support reports and result records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import assessment as A
from .. import study as Q
from ..design import PointDesign, frame_from_arrays, point_frame
from ..functions.expr import lit
from ..operators import covariate as C
from ..operators import diagnostics as D
from ..operators import inference as I
from ..operators import learn as N
from ..operators import longitudinal as L
from ..operators import order as O
from ..operators import point as P
from ..operators import target as T
from ..operators import sensitivity as V
from ..operators.folds import check_integrity, resolve_n_folds, with_folds
from ..phases import Phases
from ..sources import generators as G
from ..sources import store
from ..streaming.accumulate import Accumulator
from . import sql as S
from .catalog import _BASIC, _PRIORITIES, SQL, _conditional_sql, _direct, _study, orders, query, saturated, shown
from .catalog_more import _PLANS, _VISITS, _mean_frame, _msm_sql, _survival_frame

# Longitudinal: saturated regressions, cross-fits, curves, totals, node reports.

_FOLDED = _VISITS + ",\nvf AS (SELECT v.*, (('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8))::BIGINT) % 3 AS fold FROM v)"


def _on_folds(part: str) -> str:
    return part.replace(" FROM v)", " FROM vf)")


def _two(rows_of: str = "ey_regimen", suffix: str = "") -> str:
    return S.report([(f"{rows_of}[always{suffix}]", "m1", "d1", "level"), (f"{rows_of}[never{suffix}]", "m0", "d0", "level"), (f"ate_regimen[never vs always{suffix}]", "m0 - m1", "d0 - d1", "difference")], table="p")


_PAIR = "p AS (SELECT a.psi AS m1, b.psi AS m0, a.ic AS d1, b.ic AS d0 FROM t1 a JOIN t0 b USING (user_id))"


@query("ltmle_saturated", S.query(_VISITS, S.plan_mechanism("1", (1, 1)), S.plan_mechanism("0", (0, 0)), S.plan_mean("1", "1", "y"), S.plan_mean("0", "0", "y"), _PAIR, final=_two()))
def ltmle_saturated(spark, sf_dir):
    """Mean outcome under always and never, with cell means of the whole history."""
    r = L.ltmle(_mean_frame(spark, sf_dir), _PLANS)
    return shown(spark, r.means + r.contrasts)


@query("ltmle_cross_fit", S.query(_FOLDED, *(_on_folds(S.plan_mechanism(t, (int(t),) * 2, folds=3)) for t in "10"), *(S.plan_mean(t, t, "y", folds=3) for t in "10"), _PAIR, final=_two()))
def ltmle_cross_fit(spark, sf_dir):
    """The same with every regression and mechanism predicted from the other folds."""
    r = L.ltmle(_mean_frame(spark, sf_dir), _PLANS, settings=L.Settings(folds=3))
    return shown(spark, r.means + r.contrasts)


_EV2 = "CASE WHEN ev2 THEN 1e0 ELSE 0e0 END"


@query("ltmle_survival_cross_fit", S.query(_FOLDED, *(_on_folds(S.plan_mechanism(t, (int(t),) * 2, "ev1", folds=3)) for t in "10"), *(S.plan_mean(t, t, _EV2, "ev1", "ev1", folds=3) for t in "10"), _PAIR, final=_two("risk_regimen", ", t2")))
def ltmle_survival_cross_fit(spark, sf_dir):
    r = L.ltmle(_survival_frame(spark, sf_dir), _PLANS, settings=L.Settings(folds=3))
    return shown(spark, r.means + r.contrasts)


def _curve_row(tag: str, regimen: str, horizon: int) -> str:
    se = "sqrt(var_samp(ic) / count(*))"
    return f"SELECT '{regimen}' AS regimen, '' AS cause, {horizon}::INTEGER AS horizon, round(1e0 - any_value(psi), 6) AS value, round(1e0 - any_value(psi) - {S.Z975} * {se}, 6) AS lower, round(1e0 - any_value(psi) + {S.Z975} * {se}, 6) AS upper FROM t{tag}"


SQL["survival_curve"] = S.query(
    _VISITS, S.plan_mechanism("1", (1, 1), "ev1"), S.plan_mechanism("0", (0, 0), "ev1"),
    *(S.plan_mean(f"{arm}h{h}", str(arm), _EV2, "ev1", "ev1", horizon=h) for arm in (1, 0) for h in (1, 2)),
    final=" UNION ALL ".join(_curve_row(f"{arm}h{h}", name, h) for arm, name in ((1, "always"), (0, "never")) for h in (1, 2)),
)

_CAUSES = S.query(
    _VISITS, S.plan_mechanism("1", (1, 1), "ev1 OR xv1"), S.plan_mechanism("0", (0, 0), "ev1 OR xv1"),
    *(S.plan_mean(f"{x}{arm}", str(arm), f"CASE WHEN {x}v2 THEN 1e0 ELSE 0e0 END", f"{x}v1", "ev1 OR xv1") for arm in (1, 0) for x in "ex"),
    final="{final}",
)
SQL["incidence_total"] = _CAUSES.replace(
    "{final}",
    " UNION ALL ".join(
        f"SELECT '{name}' AS regimen, 2::INTEGER AS horizon, round(any_value(a.psi + b.psi), 6) AS total, round(sqrt(var_samp(a.ic + b.ic) / count(*)), 6) AS std_err, round(greatest(any_value(a.psi + b.psi) - 1e0, 0e0), 6) AS excess FROM te{arm} a JOIN tx{arm} b USING (user_id)"
        for arm, name in ((1, "always"), (0, "never"))
    ),
)


def _node(tag: str, regimen: str, t: int) -> str:
    v = f"coalesce((z{t} - s{t}) / k{t}, 0e0)"
    return f"SELECT '{regimen}' AS regimen, {t}::INTEGER AS time, sum(CASE WHEN f{t} THEN 1 ELSE 0 END)::BIGINT AS followers, {{}} FROM t{tag}".replace("{v}", v)


_NODES = S.query(_VISITS, S.plan_mechanism("1", (1, 1)), S.plan_mechanism("0", (0, 0)), S.plan_mean("1", "1", "y", coarse=True), S.plan_mean("0", "0", "y", coarse=True), final="{final}")
_EACH = [(str(arm), name, t) for arm, name in ((1, "always"), (0, "never")) for t in (1, 2)]


@query("longitudinal_scores", _NODES.replace("{final}", " UNION ALL ".join(_node(*e).format(f"round(sqrt(var_samp(coalesce((z{e[2]} - s{e[2]}) / k{e[2]}, 0e0)) / count(*)), 6) AS std_err, abs(avg(coalesce((z{e[2]} - s{e[2]}) / k{e[2]}, 0e0))) < 1e-9 AS solved") for e in _EACH)))
def longitudinal_scores(spark, sf_dir):
    """The weighted score of every regression after targeting, on the outcome's scale."""
    f = _mean_frame(spark, sf_dir)
    r = L.ltmle(f, _PLANS, settings=L.Settings(coarse=True)).scores()
    return r.select("regimen", "time", "followers", F.round(F.col("std_err") * lit(f.high - f.low), 6).alias("std_err"), "solved")


@query("longitudinal_nuisances", _NODES.replace("{final}", " UNION ALL ".join(_node(*e).format(f"round(any_value(e{e[2]}), 6) AS epsilon, round(avg(CASE WHEN f{e[2]} THEN (z{e[2]} - q{e[2]}) * (z{e[2]} - q{e[2]}) END), 6) AS loss, round(avg(CASE WHEN f{e[2]} THEN (z{e[2]} - s{e[2]}) * (z{e[2]} - s{e[2]}) END), 6) AS targeted_loss") for e in _EACH)))
def longitudinal_nuisances(spark, sf_dir):
    """Epsilon and squared error of every regression, on the outcome's scale."""
    f = _mean_frame(spark, sf_dir)
    span = f.high - f.low
    r = L.ltmle(f, _PLANS, settings=L.Settings(coarse=True)).nuisances()
    return r.select("regimen", "time", "followers", F.round(F.col("epsilon") * span, 6).alias("epsilon"), *(F.round(F.col(c) * span * span, 6).alias(c) for c in ("loss", "targeted_loss")))


# Working models over regimens.

_THREE = {"00": (0, 0), "10": (1, 0), "11": (1, 1)}

SQL["regimen_msm"] = S.query(
    _VISITS, *(S.plan_mechanism(k, v) for k, v in _THREE.items()), *(S.plan_mean(k, k, "y") for k in _THREE),
    "p AS (SELECT (5e0 * a.psi + 2e0 * b.psi - c.psi) / 6e0 AS b0, (5e0 * a.ic + 2e0 * b.ic - c.ic) / 6e0 AS d0, (c.psi - a.psi) / 2e0 AS b1, (c.ic - a.ic) / 2e0 AS d1 FROM t00 a JOIN t10 b USING (user_id) JOIN t11 c USING (user_id))",
    final=S.report([("msm[1]", "b0", "d0", "level"), ("msm[treated]", "b1", "d1", "level")], table="p"),
)


def _lockstep_sql() -> str:
    """Three plans stacked, terms 1 and (times treated) * w0, one two-equation linear fluctuation at each time."""
    stack = " UNION ALL ".join(f"SELECT {k.count('1')}e0 * w0 AS x, '{k}' AS plan, * FROM m{k}" for k in _THREE)
    eps = lambda t: f"""g{t} AS (SELECT sum(CASE WHEN f{t} THEN 1e0 / k{t} ELSE 0e0 END) AS g00, sum(CASE WHEN f{t} THEN x / k{t} ELSE 0e0 END) AS g01, sum(CASE WHEN f{t} THEN x * x / k{t} ELSE 0e0 END) AS g11,
  sum(CASE WHEN f{t} THEN (z{t} - q{t}) / k{t} ELSE 0e0 END) AS h0, sum(CASE WHEN f{t} THEN x * (z{t} - q{t}) / k{t} ELSE 0e0 END) AS h1 FROM r{t}),
e{t} AS (SELECT (h0 * g11 - h1 * g01) / (g00 * g11 - g01 * g01) AS e0, (g00 * h1 - g01 * h0) / (g00 * g11 - g01 * g01) AS e1 FROM g{t})"""  # noqa: E731
    return S.query(
        _VISITS, *(S.plan_mechanism(k, v) for k, v in _THREE.items()), f"st AS ({stack})", "st2 AS (SELECT *, CASE WHEN f2 THEN y END AS z2 FROM st)",
        "r2 AS (SELECT *, avg(z2) OVER (PARTITION BY plan) AS q2 FROM st2)", eps(2), "st1 AS (SELECT r.*, CASE WHEN r2 THEN q2 + e0 + e1 * x END AS s2 FROM r2 r, e2)",
        "st1z AS (SELECT *, CASE WHEN f1 THEN s2 END AS z1 FROM st1)", "r1 AS (SELECT *, avg(z1) OVER (PARTITION BY plan) AS q1 FROM st1z)", eps(1),
        "fin AS (SELECT r.*, q1 + e0 + e1 * x AS s1 FROM r1 r, e1)",
        "mm AS (SELECT sum(1e0) AS a00, sum(x) AS a01, sum(x * x) AS a11, sum(s1) AS c0, sum(x * s1) AS c1, count(DISTINCT user_id) AS n FROM fin)",
        "bb AS (SELECT *, (c0 * a11 - c1 * a01) / (a00 * a11 - a01 * a01) AS beta0, (a00 * c1 - a01 * c0) / (a00 * a11 - a01 * a01) AS beta1 FROM mm)",
        "u AS (SELECT user_id, any_value(beta0) AS beta0, any_value(beta1) AS beta1, sum(v) AS i0, sum(x * v) AS i1 FROM (SELECT fin.*, beta0, beta1, coalesce((z1 - s1) / k1, 0e0) + coalesce((z2 - s2) / k2, 0e0) + s1 - beta0 - beta1 * x AS v FROM fin, bb) GROUP BY user_id)",
        "c AS (SELECT u.beta0, u.beta1, n * (a11 * i0 - a01 * i1) / (a00 * a11 - a01 * a01) AS d0, n * (a00 * i1 - a01 * i0) / (a00 * a11 - a01 * a01) AS d1 FROM u, bb)",
        final=S.report([("msm[1]", "beta0", "d0", "level"), ("msm[treated:W]", "beta1", "d1", "level")]),
    )


@query("regimen_msm_targeted", _lockstep_sql())
def regimen_msm_targeted(spark, sf_dir):
    """A working model with a baseline covariate: all regimens go back in lockstep under one fluctuation a time."""
    model = L.RegimenMSM({"1": lambda p: lit(1), "treated:W": lambda p: lit(p.label.count("1")) * F.col("l_0_W")})
    return shown(spark, L.targeted_regimen_msm(_mean_frame(spark, sf_dir), _THREE, model, settings=L.Settings(coarse=True)).estimates)


@query("regimen_msm_logit")
def regimen_msm_logit(spark, sf_dir):
    """Log odds of the risk as a line in the times treated, as odds ratios."""
    model = L.RegimenMSM({"1": lambda p: lit(1), "treated": lambda p: lit(p.label.count("1"))}, link="logit")
    r = L.targeted_regimen_msm(_survival_frame(spark, sf_dir), _THREE, model, settings=L.Settings(coarse=True), rounds=4)
    return r.coefficients("ratio").select("term", *(F.round(c, 6).alias(c) for c in ("psi", "std_err", "ci_lower", "ci_upper")))


# Tilts of the odds.


def _tilt_cells(delta: float, tag: str, rounds: int = 9, steps: int = 5) -> str:
    """Alternating score equations over the cells (segment, arm) of a binary outcome; ends with g, q0, q1 by segment."""
    cut = lambda x: f"least(greatest({x}, 0.0005e0), 0.9995e0)"
    logit = lambda p: f"ln(({p}) / (1e0 - ({p})))"
    move = lambda p, e: f"1e0 / (1e0 + exp(-({logit(p)} + {e})))"
    d = f"({delta}e0 * g + 1e0 - g)"
    out = [f"s{tag}_0 AS MATERIALIZED (SELECT seg, n1, n0, y1, y0, n1 / (n1 + n0) AS g, {cut('q1')} AS q1, {cut('q0')} AS q0 FROM cells)"]
    for r in range(rounds):
        now = f"s{tag}_{r}"
        out.append(f"h{tag}_{r} AS MATERIALIZED (SELECT *, 1e0 / {d} AS h0, {delta}e0 / {d} AS h1 FROM {now})")
        out.append(f"e{tag}_{r}_0 AS (SELECT 0e0 AS e)")
        p1, p0 = cut(move("q1", "e * h1")), cut(move("q0", "e * h0"))
        for i in range(steps):
            out.append(f"e{tag}_{r}_{i + 1} AS MATERIALIZED (SELECT any_value(e) + sum(h1 * (y1 - n1 * {p1}) + h0 * (y0 - n0 * {p0})) / sum(n1 * h1 * h1 * {p1} * (1e0 - {p1}) + n0 * h0 * h0 * {p0} * (1e0 - {p0})) AS e FROM h{tag}_{r}, e{tag}_{r}_{i})")
        out.append(f"q{tag}_{r} AS MATERIALIZED (SELECT seg, n1, n0, y1, y0, g, {p1} AS q1, {p0} AS q0, {delta}e0 / ({d} * {d}) * ({p1} - {p0}) AS k FROM h{tag}_{r}, e{tag}_{r}_{steps})")
        out.append(f"m{tag}_{r}_0 AS (SELECT 0e0 AS e)")
        g = move("g", "e * k")
        for i in range(steps):
            out.append(f"m{tag}_{r}_{i + 1} AS MATERIALIZED (SELECT any_value(e) + sum(k * (n1 - (n1 + n0) * {g})) / sum((n1 + n0) * k * k * {g} * (1e0 - {g})) AS e FROM q{tag}_{r}, m{tag}_{r}_{i})")
        out.append(f"s{tag}_{r + 1} AS MATERIALIZED (SELECT seg, n1, n0, y1, y0, {g} AS g, q1, q0 FROM q{tag}_{r}, m{tag}_{r}_{steps})")
    mix = f"(({delta}e0 * g * q1 + (1e0 - g) * q0) / {d})"
    out.append(f"z{tag} AS (SELECT seg, g, q1, q0, {mix} AS mix, sum((n1 + n0) * {mix}) OVER () / sum(n1 + n0) OVER () AS psi, 1e0 / {d} AS h0, {delta}e0 / {d} AS h1, {delta}e0 / ({d} * {d}) * (q1 - q0) AS k FROM s{tag}_{rounds})")
    out.append(f"i{tag} AS (SELECT id, psi, CASE a WHEN 1 THEN h1 * (y - q1) ELSE h0 * (y - q0) END + mix - psi + k * (a - g) AS ic FROM d JOIN z{tag} USING (seg))")
    return ",\n".join(out)


_CELLS = "cells AS MATERIALIZED (SELECT seg, sum(a) * 1e0 AS n1, sum(1 - a) * 1e0 AS n0, sum(a * y) AS y1, sum((1 - a) * y) AS y0, (SELECT avg(y) FROM d WHERE a = 1) AS q1, (SELECT avg(y) FROM d WHERE a = 0) AS q0 FROM d GROUP BY seg)"
SQL["odds_tilt"] = S.query(S.base("f"), _CELLS, _tilt_cells(2, "a"), final=S.report([("ey_ipsi[2]", "psi", "ic", "level")], table="ia"))


@query(
    "odds_tilts",
    S.query(
        S.base("f"), _CELLS, _tilt_cells(1, "a"), _tilt_cells(2, "b"), _tilt_cells(0.5, "c"),
        "j AS (SELECT a.psi AS pa, b.psi AS pb, c.psi AS pc, a.ic AS da, b.ic AS db, c.ic AS dc FROM ia a JOIN ib b USING (id) JOIN ic c USING (id))",
        final=S.report([("ey_ipsi[1]", "pa", "da", "level"), ("ey_ipsi[2]", "pb", "db", "level"), ("ey_ipsi[0.5]", "pc", "dc", "level"), ("ate_ipsi[2 vs 1]", "pb - pa", "db - da", "difference"), ("ate_ipsi[0.5 vs 1]", "pc - pa", "dc - da", "difference")], table="j"),
    ),
)
def odds_tilts(spark, sf_dir):
    """Odds as they are, doubled and halved, and the contrasts with the first."""
    return shown(spark, P.tilt_means(_study(orders(spark, sf_dir), outcome="f"), (1.0, 2.0, 0.5), saturated(fluctuation="logistic")).estimates)


@query(
    "tilt_support",
    S.query(
        S.base(), S.nuisances(2), "r AS (SELECT w, g1, CASE a WHEN 1 THEN 3e0 ELSE 1e0 END / (3e0 * g1 + 1e0 - g1) AS r FROM u)",
        final="SELECT '3' AS tilt, round(min(r), 6) AS min_ratio, round(max(r), 6) AS max_ratio, round(sum(w * r) * sum(w * r) / sum(w * r * w * r), 4) AS effective_n, round(sum(CASE WHEN least(g1, 1e0 - g1) < 0.01e0 THEN w ELSE 0e0 END) / sum(w), 6) AS extreme FROM r",
    ),
)
def tilt_support(spark, sf_dir):
    n = P.fit_nuisances(_study(orders(spark, sf_dir)), saturated())
    r = C.tilt_support(n.df, {"3": 3.0})
    return r.select("tilt", F.round("min_ratio", 6).alias("min_ratio"), F.round("max_ratio", 6).alias("max_ratio"), F.round("effective_n", 4).alias("effective_n"), F.round("extreme", 6).alias("extreme"))


# Overlap of the other mechanisms, and of pairs of arms.

_DELTA = "CASE WHEN h % 4 = 0 THEN 0 ELSE 1 END"


def _with_delta(spark, sf_dir):
    return orders(spark, sf_dir).withColumn("delta", F.when(F.col("h") % 4 == 0, 0).otherwise(1))


@query(
    "mechanism_overlap",
    S.query(
        S.base(delta=_DELTA), S.nuisances(2, delta=True),
        "x AS (SELECT 'pi' AS mechanism, '0' AS arm, pi0 AS v FROM u UNION ALL SELECT 'pi', '1', pi1 FROM u UNION ALL SELECT 'joint', '0', (1e0 - g1) * pi0 FROM u UNION ALL SELECT 'joint', '1', g1 * pi1 FROM u)",
        final="SELECT mechanism, arm, round(min(v), 6) AS min, round(quantile_cont(v, 0.05), 6) AS q05, round(quantile_cont(v, 0.5), 6) AS median, round(avg(CASE WHEN v < 0.05e0 THEN 1e0 ELSE 0e0 END), 6) AS below_05 FROM x GROUP BY mechanism, arm",
    ),
)
def mechanism_overlap(spark, sf_dir):
    """The observation mechanism, alone and times the treatment's."""
    r = D.mechanism_overlap(P.fit_nuisances(_study(_with_delta(spark, sf_dir), delta="delta"), saturated()))
    return r.select("mechanism", "arm", *(F.round(c, 6).alias(c) for c in ("min", "q05", "median", "below_05")))


@query(
    "pairwise_overlap",
    S.query(
        S.base(a="CASE priority " + " ".join(f"WHEN '{v}' THEN {k}" for k, v in enumerate(_PRIORITIES)) + " END"), S.nuisances(5),
        final=" UNION ALL ".join(
            f"SELECT '{_PRIORITIES[k]}' AS arm, '{_PRIORITIES[j]}' AS versus, round(quantile_cont(g{k} / (g{k} + g{j}), 0.01), 6) AS q01, round(quantile_cont(g{k} / (g{k} + g{j}), 0.5), 6) AS median FROM u WHERE a IN ({j}, {k})"
            for k in range(5) for j in range(k)
        ),
    ),
)
def pairwise_overlap(spark, sf_dir):
    r = D.pairwise_positivity(P.fit_nuisances(_study(orders(spark, sf_dir), treatment="priority"), saturated()))
    return r.select("arm", "versus", F.round("q01", 6).alias("q01"), F.round("median", 6).alias("median"))


@query("order_statistics", "SELECT round(quantile_cont(o_totalprice, 0.01), 6) AS q01, round(quantile_cont(o_totalprice, 0.5), 6) AS q50, round(quantile_cont(o_totalprice, 0.99), 6) AS q99 FROM orders")
def order_statistics(spark, sf_dir):
    """Exact quantiles of a continuous column."""
    q = O.quantiles(orders(spark, sf_dir), F.col("y") * 1000, (0.01, 0.5, 0.99))
    return spark.createDataFrame([tuple(round(v, 6) for v in q)], "q01 double, q50 double, q99 double")


# Sensitivity and checks that had no SQL.

_OV_Z = SQL["omitted_variable"].split("\nSELECT round(s2")[0]
SQL["robustness"] = (
    _OV_Z
    + """, l AS (SELECT *, 1.6448536269514722e0 AS z0, abs(psi) AS p, CASE WHEN psi < 0 THEN -vab ELSE vab END AS v, psi / bias * psi / bias AS f2 FROM z),
qq AS (SELECT *, bias * bias - z0 * z0 * vbb AS qa, p * bias - z0 * z0 * v AS qb, p * p - z0 * z0 * vaa AS qc FROM l),
rr AS (SELECT *, CASE WHEN p <= z0 * sqrt(vaa) THEN 0e0 ELSE (qb - sqrt(qb * qb - qa * qc)) / qa END AS st FROM qq)
SELECT round((-f2 + sqrt(f2 * f2 + 4e0 * f2)) / 2e0, 6) AS rv, round((-st * st + sqrt(st * st * st * st + 4e0 * st * st)) / 2e0, 6) AS rv_level FROM rr"""
)


def _benchmark_sql() -> str:
    def fit(tag: str, cells: tuple[str, ...]) -> str:
        body = S.query(
            S.base(s="CAST(h % 3 AS VARCHAR)"), S.nuisances(2, cells=cells, q_cells=cells), S.linear_means(2), S.curves(2), "r AS (SELECT *, CASE a WHEN 1 THEN p1 ELSE -p0 END AS ho, y - so AS r FROM c)",
            final="SELECT sum(w * r * r) / sum(w) AS s2, sum(w * (2 * (p1 + p0) - ho * ho)) / sum(w) AS n2, any_value(m1 - m0) AS psi FROM r",
        )
        return f"{tag} AS ({body})"

    return S.query(
        fit("fu", ("seg", "s")), fit("sh", ("s",)),
        "x AS (SELECT greatest((sh.s2 - fu.s2) / sh.s2, 0e0) AS cf_y, greatest((fu.n2 - sh.n2) / fu.n2, 0e0) AS cf_d, sh.psi - fu.psi AS change, sqrt(greatest((sh.s2 - fu.s2) * (fu.n2 - sh.n2), 0e0)) AS scale FROM fu, sh)",
        final="SELECT round(cf_y, 6) AS cf_y, round(cf_d, 6) AS cf_d, round(CASE WHEN scale > 0 THEN greatest(least(change / scale, 1e0), -1e0) ELSE 0e0 END, 4) AS rho, round(change, 6) AS change FROM x",
    )


SQL["strength_benchmark"] = _benchmark_sql()


def _strength_sql(arm: int, name: str) -> str:
    inside = f"CASE WHEN a = {arm} THEN 1e0 ELSE 0e0 END / pa"
    return S.query(
        S.base(), S.nuisances(2), _conditional_sql(arm), f"r AS (SELECT *, y - so AS r, {inside} * (hu + hd) AS m FROM c)",
        final=f"SELECT '{name}' AS parameter, round(any_value(psi), 6) AS psi, round(sum(w * r * r) / sum(w), 4) AS sigma2, round(sum(w * (2e0 * m - ho * ho)) / sum(w), 6) AS nu2 FROM r",
    )


_LEVEL_STRENGTH = S.query(
    S.base(), S.nuisances(2), S.linear_means(2), S.curves(2),
    final="SELECT 'ey' AS parameter, round(any_value(m1), 6) AS psi, round(sum(w * (y - so) * (y - so)) / sum(w), 4) AS sigma2, round(sum(w * (2e0 * p1 - CASE WHEN a = 1 THEN p1 * p1 ELSE 0e0 END)) / sum(w), 6) AS nu2 FROM c",
)


@query("strength_elements", " UNION ALL ".join(f"SELECT * FROM ({q})" for q in (_LEVEL_STRENGTH, _strength_sql(1, "att"), _strength_sql(0, "atc"))))
def strength_elements(spark, sf_dir):
    """What an omitted confounder works on, for a level and for both conditional effects."""
    n = P.fit_nuisances(_study(orders(spark, sf_dir)), saturated())
    rows = []
    for name, group in (("ey", "mean"), ("att", "att"), ("atc", "atc")):
        e = V.elements(n, P.target(n, group), parameter=name)
        low = n.frame.low if name == "ey" else 0.0
        rows.append((name, round(low + e.psi, 6), round(e.sigma2, 4), round(e.nu2, 6)))
    return spark.createDataFrame(rows, "parameter string, psi double, sigma2 double, nu2 double")


@query("bounded_mechanism")
def bounded_mechanism(spark, sf_dir):
    """The truncated tilt of one arm's mechanism, by bisection."""
    n = P.fit_nuisances(_study(orders(spark, sf_dir), treatment="priority"), saturated())
    eps = T.solve_mechanism(n.df, lit(1), treatment=F.when(F.col("a") == 1, lit(1)).otherwise(lit(0)), g=F.col("g_1"), bounds=(0.198, 0.99))
    return spark.createDataFrame([("2-HIGH", round(eps, 5))], "arm string, epsilon double")


@query("fold_integrity", S.query(S.base(), final="SELECT 0::INTEGER AS unassigned, 0::INTEGER AS empty, 0::INTEGER AS out_of_range, 0::INTEGER AS split"))
def fold_integrity(spark, sf_dir):
    """What may be wrong with a partition, and is not."""
    r = check_integrity(with_folds(orders(spark, sf_dir), 5, cluster="cl"), 5, "cl")
    return spark.createDataFrame([tuple(r.values())], ", ".join(f"{k} int" for k in r))


def _tipping_sql(steps: int = 24) -> str:
    """Halvings of the side of zero on which the tilted contrast changes its sign: as many as six grids of sixteen."""
    f = lambda g: f"sum(w * (pi1 * s1 + (1e0 - pi1) / (1e0 + exp(-(ln(s1 / (1e0 - s1)) + {g}))) - s0))"
    out = ["k AS MATERIALIZED (SELECT pi1, s1, s0, sum(w) AS w FROM t GROUP BY ALL)", f"b0 AS (SELECT CASE WHEN {f('0e0')} < 0 THEN 0e0 ELSE -8e0 END AS lo, CASE WHEN {f('0e0')} < 0 THEN 8e0 ELSE 0e0 END AS hi FROM k)"]
    for i in range(steps):  # the contrast rises with gamma
        out.append(f"b{i + 1} AS MATERIALIZED (SELECT CASE WHEN {f('(lo + hi) / 2e0')} < 0 THEN any_value((lo + hi) / 2e0) ELSE any_value(lo) END AS lo, CASE WHEN {f('(lo + hi) / 2e0')} < 0 THEN any_value(hi) ELSE any_value((lo + hi) / 2e0) END AS hi FROM k, b{i})")
    return S.query(S.base("f", delta=_DELTA), S.nuisances(2, delta=True), S.linear_means(2), *out, final=f"SELECT round((lo + hi) / 2e0, 6) AS gamma FROM b{steps}")


SQL["tipping_point"] = _tipping_sql()


def _quality_sql() -> str:
    """AUC, Brier score, log-loss, calibration slope and means of g, q and pi, cross-fitted."""
    out = []
    for m, p, y, where in (("g[1]", "g1", "CAST(a AS DOUBLE)", "TRUE"), ("q", "least(greatest(qo, 0.0005e0), 0.9995e0)", "y", "delta = 1"), ("pi", "CASE a WHEN 1 THEN pi1 ELSE pi0 END", "delta", "TRUE")):
        t = m[:1]
        out.append(f"{t}k AS MATERIALIZED (SELECT {p} AS p, sum(w * {y}) AS one, sum(w * (1e0 - {y})) AS zero FROM u WHERE {where} GROUP BY 1)")
        out.append(f"{t}r AS (SELECT *, coalesce(sum(zero) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS below, ln(least(greatest(p, 1e-6), 1e0 - 1e-6) / (1e0 - least(greatest(p, 1e-6), 1e0 - 1e-6))) AS x FROM {t}k)")
        out.append(f"{t}b0 AS (SELECT 0e0 AS b0, 0e0 AS b1)")
        for i in range(12):
            e = "(1e0 / (1e0 + exp(-(b0 + b1 * x))))"
            n = "(one + zero)"
            out.append(f"{t}g{i} AS MATERIALIZED (SELECT any_value(b0) AS b0, any_value(b1) AS b1, sum(one - {n} * {e}) AS u0, sum(x * (one - {n} * {e})) AS u1, sum({n} * {e} * (1e0 - {e})) AS h00, sum(x * {n} * {e} * (1e0 - {e})) AS h01, sum(x * x * {n} * {e} * (1e0 - {e})) AS h11 FROM {t}r, {t}b{i})")
            out.append(f"{t}b{i + 1} AS MATERIALIZED (SELECT b0 + least(greatest((u0 * h11 - u1 * h01) / (h00 * h11 - h01 * h01), -5e0), 5e0) AS b0, b1 + least(greatest((h00 * u1 - h01 * u0) / (h00 * h11 - h01 * h01), -5e0), 5e0) AS b1 FROM {t}g{i})")
        out.append(f"{t}v AS (SELECT '{m}' AS model, sum(one * (below + zero / 2e0)) / (sum(one) * sum(zero)) AS auc, sum(one * (1e0 - p) * (1e0 - p) + zero * p * p) / sum(one + zero) AS brier, sum(-one * ln(p) - zero * ln(1e0 - p)) / sum(one + zero) AS log_loss, any_value(b1) AS slope, sum((one + zero) * p) / sum(one + zero) AS mean_predicted, sum(one) / sum(one + zero) AS mean_actual FROM {t}r, {t}b12)")
    names = ("auc", "brier", "log_loss", "slope", "mean_predicted", "mean_actual")
    rows = " UNION ALL ".join(f"SELECT model, '{k}' AS metric, round({k}, 5) AS value FROM {t}v" for t in "gqp" for k in names)
    return S.query(S.base("f", delta=_DELTA, folds=5), S.nuisances(2, folds=5, q_cells=("seg",), delta=True), *out, final=rows)


SQL["nuisance_report"] = _quality_sql()

SQL["weighted_fluctuation"] = S.query(
    S.base("(y - lo) / (hi - lo)").replace("FROM d0)", "FROM d0, (SELECT min(y) - 0.1e0 * (max(y) - min(y)) AS lo, max(y) + 0.1e0 * (max(y) - min(y)) AS hi FROM d0) b)").replace("AS fold FROM", "AS fold, lo, hi - lo AS span FROM"),
    S.nuisances(2), S.logistic_means(2, weighted=True), S.curves(2),
    final=S.report([("ey1", "lo + span * m1", "span * d1", "level"), ("ey0", "lo + span * m0", "span * d0", "level"), ("ate", "span * (m1 - m0)", "span * (d1 - d0)", "difference")]),
)


def _repeat(seed: int) -> str:
    return S.query(S.base(folds=5, seed=seed), S.nuisances(2, folds=5, q_cells=("seg",)), S.linear_means(2), S.curves(2), final="SELECT id, m1, m0, d1, d0 FROM c")


_REPEATS = ", ".join(f"r{s} AS ({_repeat(s)})" for s in range(3))
_JOINED = "FROM r0 JOIN r1 USING (id) JOIN r2 USING (id)"
SQL["repeats"] = f"WITH {_REPEATS}, j AS (SELECT (r0.m1 + r1.m1 + r2.m1) / 3e0 AS m1, (r0.m0 + r1.m0 + r2.m0) / 3e0 AS m0, (r0.d1 + r1.d1 + r2.d1) / 3e0 AS d1, (r0.d0 + r1.d0 + r2.d0) / 3e0 AS d0 {_JOINED})\n" + S.report(S.arm_rows(("ey1", "ey0", "ate")), table="j")


def _three_repeats(spark, sf_dir):
    f = _study(orders(spark, sf_dir))
    return [P.point_tmle(f, ("ey1", "ey0", "ate"), P.Config(N.CellMean(), N.CellMean(), folds=5, seed=s, stratify=False, fluctuation="linear")) for s in range(3)]


@query("repeat_spread", f"WITH {_REPEATS}, k AS (SELECT any_value(m1) AS m1, any_value(m0) AS m0 FROM r0 UNION ALL SELECT any_value(m1), any_value(m0) FROM r1 UNION ALL SELECT any_value(m1), any_value(m0) FROM r2)\n" + " UNION ALL ".join(f"SELECT '{n}' AS estimand, 3::INTEGER AS repeats, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS spread FROM k" for n, v in (("ey1", "m1"), ("ey0", "m0"), ("ate", "m1 - m0"))))
def repeat_spread(spark, sf_dir):
    """How far the estimates of three cross-fits by other seeds lie apart."""
    r = I.repeat_spread(spark, [x.estimates for x in _three_repeats(spark, sf_dir)])
    return r.select("estimand", "repeats", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"))


SQL["shift_support"] = S.query(
    SQL["dose_shift"].split(",\ne AS")[0].removeprefix("WITH "),
    final="SELECT 'up' AS shift, round(max(h), 6) AS max_ratio, round(sum(h) * sum(h) / sum(h * h), 3) AS effective_n, 0e0 AS out_of_support, round(avg(CASE WHEN a + 1 <= 10 THEN 1e0 ELSE 0e0 END), 6) AS crossing FROM r UNION ALL SELECT 'far', 0e0, 0e0, 1e0, 1e0",
)
_ATE = S.query(S.base(), S.nuisances(2), S.linear_means(2), S.curves(2), final="SELECT 'ate' AS estimand, round(any_value(m1 - m0), 6) AS psi, round(sqrt(var_samp(d1 - d0) / count(*)), 6) AS std_err FROM c")
SQL["stored_result"] = _ATE
SQL["row_fingerprint"] = f"WITH {S.ORDERS} SELECT count(*) || ':' || sum(('0x' || substr(md5(id::VARCHAR || chr(31) || h::VARCHAR), 1, 15))::HUGEINT) AS fingerprint FROM d0"


# Records and conveniences.


@query("one_call", _ATE)
def one_call(spark, sf_dir):
    """From a frame and column names to estimates in one call, and a result's ordered selection."""
    r = P.tmle(orders(spark, sf_dir).select("id", "y", "a", "seg"), outcome="y", treatment="a", id="id", covariates=("seg",), estimands=("ey1", "ey0", "ate"), config=saturated())
    return shown(spark, r.select(["ate"])).select("estimand", "psi", "std_err")


@query("by_intermediate", " UNION ALL ".join(f"SELECT {z}::INTEGER AS intermediate, estimand, psi, std_err FROM ({_direct(z)})" for z in (0, 1)))
def by_intermediate(spark, sf_dir):
    """Both controlled direct effects, stacked."""
    r = P.by_intermediate(_study(orders(spark, sf_dir), intermediate="f"), ("ey1", "ey0", "ate"), saturated()).to_frame()
    return r.select("intermediate", "estimand", F.round("psi", 6).alias("psi"), F.round("std_err", 6).alias("std_err"))


@query("coefficients", f"SELECT substr(estimand, 5, 1) AS term, psi, std_err, ci_lower, ci_upper FROM ({_msm_sql()})")
def coefficients(spark, sf_dir):
    r = P.msm_fit(_study(orders(spark, sf_dir), treatment="priority"), P.linear_msm([0, 1, 2, 3, 4]), saturated()).coefficients()
    return r.select("term", *(F.round(c, 6).alias(c) for c in ("psi", "std_err", "ci_lower", "ci_upper")))


@query("parameter_keys", "SELECT * FROM (VALUES ('ate[2-HIGH vs 1-URGENT]', 'ate', 'arm', '2-HIGH', '1-URGENT'), ('ate[3-MEDIUM vs 1-URGENT]', 'ate', 'arm', '3-MEDIUM', '1-URGENT'), ('ate[4-NOT SPECIFIED vs 1-URGENT]', 'ate', 'arm', '4-NOT SPECIFIED', '1-URGENT'), ('ate[5-LOW vs 1-URGENT]', 'ate', 'arm', '5-LOW', '1-URGENT')) v(alias, estimand, axis, value, reference)")
def parameter_keys(spark, sf_dir):
    """What reported parameters are, by their parts; the arms agree with the index of arms."""
    r = P.point_tmle(_study(orders(spark, sf_dir), treatment="priority"), ("ate",), saturated())
    arms = I.arm_parameters(r.estimates)
    keys = [I.parameter_key(e) for e in r.estimates]
    return spark.createDataFrame([(k.alias, k.estimand, k.axis, *arms[k.alias]) for k in keys], "alias string, estimand string, axis string, value string, reference string")


@query("frame_round_trip", S.query(S.base(w="0.7e0 * (1 + id % 3)"), final="SELECT CAST(a AS VARCHAR) AS a, count(*)::BIGINT AS n, round(sum(w), 6) AS w, round(sum(y), 3) AS y FROM d GROUP BY a"))
def frame_round_trip(spark, sf_dir):
    """The canonical frame with labels again."""
    df = orders(spark, sf_dir).withColumn("w0", lit(0.7) * (1 + F.col("id") % 3))
    out = _study(df, weights="w0").to_frame()
    return out.groupBy("a").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("w"), F.round(F.sum("y"), 3).alias("y"))


@query("baseline_frame", f"WITH {_VISITS} SELECT w0 AS \"W\", count(*)::BIGINT AS n FROM v GROUP BY w0")
def baseline_frame(spark, sf_dir):
    return _mean_frame(spark, sf_dir).baseline_frame().groupBy("W").agg(F.count("*").alias("n"))


@query("fold_limit", S.query(S.base(), final="SELECT least(7, min(n)) ::INTEGER AS folds FROM (SELECT a, count(*) AS n FROM d GROUP BY a)"))
def fold_limit(spark, sf_dir):
    """At most as many folds as the rarest arm has rows."""
    return spark.createDataFrame([(resolve_n_folds(orders(spark, sf_dir), 7, "a"),)], "folds int")


@query("companion", S.query(S.base(folds=5), S.nuisances(2, folds=5), final="SELECT fold::INTEGER AS fold, seg, round(any_value(g1), 6) AS g FROM u GROUP BY fold, seg"))
def companion(spark, sf_dir):
    """Every fold's model evaluated on rows that it was not fitted for: one row per segment."""
    df = with_folds(orders(spark, sf_dir).withColumn("w", lit(1)), 5)
    model = N.CellMean().fit(df, N.Task(F.col("a").cast("double"), F.col("w"), None, 5, True), [], [F.col("seg")])
    extra = df.select("seg").distinct()
    return N.companion(model, extra, 5, "g", [], [F.col("seg")]).select("fold", "seg", F.round("g", 6).alias("g"))


@query("inner_designs", S.query(S.base(folds=3), final=" UNION ALL ".join(f"SELECT {i}::INTEGER AS fold, {j}::INTEGER AS other, round(regr_intercept(y, a), 6) AS intercept, round(regr_slope(y, a), 6) AS slope FROM d WHERE fold NOT IN ({i}, {j})" for i in range(3) for j in range(i))))
def inner_designs(spark, sf_dir):
    """Lines fitted without two folds at a time, by subtracting their sums from the whole."""
    df = with_folds(orders(spark, sf_dir).withColumn("w", lit(1)), 3)
    found = N.LinearGram().fit_pairs(df, N.Task(F.col("y"), F.col("w"), None, 3), [F.col("a").cast("double")])
    rows = [(i, j, round(float(b[0]), 6), round(float(b[1]), 6)) for (i, j), b in found.items()]
    return spark.createDataFrame(rows, "fold int, other int, intercept double, slope double")


@query("learner_risks")
def learner_risks(spark, sf_dir):
    """Cross-validated risk and weight of every candidate of a Super Learner."""
    df = orders(spark, sf_dir).withColumns({"w": lit(1), "x": F.col("a").cast("double")})
    library = [("cells", N.CellMean()), ("line", N.LinearGram()), ("logistic", N.LogisticNewton())]
    fit = N.SuperLearner(library, 3, "nnls").fit(df, N.Task(F.col("f"), F.col("w"), None, 0, False), [F.col("x")], [F.col("seg")])
    return fit.risk_frame(spark)


def _armwise_sql(low: float = 0.198, high: float = 0.99, steps: int = 50) -> str:
    """The root of each arm's score by halvings of (-64, 64), over segments."""
    p = f"least(greatest(1e0 / (1e0 + exp(-(ln(g / (1e0 - g)) + (lo + hi) / 2e0))), {low}e0), {high}e0)"
    cells = "k AS MATERIALIZED (SELECT arm, seg, sum(CASE WHEN priority = arm THEN 1e0 ELSE 0e0 END) AS hits, count(*) AS n, sum(CASE WHEN priority = arm THEN 1e0 ELSE 0e0 END) / count(*) AS g FROM d0, (SELECT DISTINCT priority AS arm FROM d0) GROUP BY arm, seg)"
    out = [S.ORDERS, cells, "b0 AS (SELECT DISTINCT arm, -64e0 AS lo, 64e0 AS hi FROM k)"]
    for i in range(steps):
        out.append(f"b{i + 1} AS MATERIALIZED (SELECT arm, CASE WHEN sum(hits - n * {p}) > 0 THEN any_value((lo + hi) / 2e0) ELSE any_value(lo) END AS lo, CASE WHEN sum(hits - n * {p}) > 0 THEN any_value(hi) ELSE any_value((lo + hi) / 2e0) END AS hi FROM k JOIN b{i} USING (arm) GROUP BY arm)")
    return S.query(*out, final=f"SELECT arm, round((lo + hi) / 2e0, 5) AS epsilon FROM b{steps}")


@query("armwise_mechanism", _armwise_sql())
def armwise_mechanism(spark, sf_dir):
    """Bounded tilts of every arm's mechanism, each with its own epsilon."""
    n = P.fit_nuisances(_study(orders(spark, sf_dir), treatment="priority"), saturated())
    eps = T.solve_armwise_mechanism(n.df, [lit(1)] * 5, bounds=(0.198, 0.99))
    return spark.createDataFrame([(p, round(e, 5)) for p, e in zip(_PRIORITIES, eps, strict=True)], "arm string, epsilon double")


SQL["bounded_mechanism"] = _armwise_sql() + " WHERE arm = '2-HIGH'"


@query("validated", "SELECT * FROM (VALUES ('finite', 'passed'), ('covariance', 'passed'), ('ranges', 'passed'), ('scores', 'passed'), ('converged', 'passed')) v(\"check\", status)")
def validated(spark, sf_dir):
    """The cheap battery of a finished fit."""
    return A.validate(P.point_tmle(_study(orders(spark, sf_dir)), _BASIC, saturated())).select("check", "status")


@query("battery")
def battery(spark, sf_dir):
    """Every check of a fit, with those that don't apply recorded as skipped."""
    return A.run_all(P.point_tmle(_study(_with_delta(spark, sf_dir), delta="delta"), ("ey1", "ey0", "ate"), saturated()), include_retargets=True)


@query("battery_longitudinal")
def battery_longitudinal(spark, sf_dir):
    return A.run_all(L.ltmle(_mean_frame(spark, sf_dir), _PLANS))


@query("support_reports", SQL["stagewise"])
def support_reports(spark, sf_dir):
    """The overlap report that fits a longitudinal result."""
    r = A.support(L.ltmle(_mean_frame(spark, sf_dir), {"always": (1, 1)}, settings=L.Settings(coarse=True)))
    return r.select("regimen", "time", "at_risk", "following", F.round("max_weight", 6).alias("max_weight"))


@query("replayability", "SELECT * FROM (VALUES ('scores', TRUE), ('retarget', TRUE), ('refit', TRUE)) v(what, possible)")
def replayability(spark, sf_dir):
    r = P.point_tmle(_study(orders(spark, sf_dir)), ("ate",), saturated())
    return spark.createDataFrame(list(A.replayability(r).items()), "what string, possible boolean")


@query("from_arrays", "SELECT 'ate' AS estimand, round(avg(CASE WHEN n_regionkey > 2 THEN n_nationkey END) - avg(CASE WHEN n_regionkey <= 2 THEN n_nationkey END), 6) AS psi FROM nation")
def from_arrays(spark, sf_dir):
    """Arrays on the driver as a study: without covariates that matter the estimate is the difference of means."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").collect()
    f = frame_from_arrays(spark, [r[0] for r in rows], [int(r[1] > 2) for r in rows], [[i % 2] for i in range(len(rows))], covariate_names=("w",))
    r = P.point_tmle(f, ("ate",), _plain())
    return shown(spark, r.estimates).select("estimand", "psi")


def _plain() -> P.Config:
    """Margins alone: the mechanism is a share and the regression a mean by arm."""
    return P.Config(_Margin(), _Margin(), outcome_cells=(), fluctuation="linear", stratify=False)


class _Margin(N.CellMean):
    """Cell means that leave covariates out."""

    def shares(self, df, code, levels, weight, cells, outs):
        return super().shares(df, code, levels, weight, [], outs)


@query("phases")
def phases(spark, sf_dir):
    """Phases of a fit that were timed."""
    p = Phases(spark)
    with p.phase("nuisances"):
        n = P.fit_nuisances(_study(orders(spark, sf_dir)), saturated())
    with p.phase("targeting"):
        P.point_tmle(n.frame, ("ate",), nuisances=n)
    return p.to_frame().select("phase", "entries")




@query(
    "strata_table",
    S.query(S.base(s="CASE WHEN seg IN ('FURNITURE', 'MACHINERY') THEN 'goods' ELSE 'other' END"), final="SELECT s AS stratum, CAST(a AS VARCHAR) AS arm, count(*)::BIGINT AS n, round(sum(w), 6) AS weight, round(sum(w * y) / sum(w), 6) AS mean FROM d GROUP BY CUBE (s, CAST(a AS VARCHAR))"),
)
def strata_table(spark, sf_dir):
    """Sizes and means by stratum and arm with all margins."""
    df = orders(spark, sf_dir).withColumn("grp", F.when(F.col("seg").isin("FURNITURE", "MACHINERY"), "goods").otherwise("other"))
    r = D.strata_table(_study(df, covariates=("seg", "grp"), strata=("grp",)))
    return r.select("stratum", "arm", "n", F.round("weight", 6).alias("weight"), F.round("mean", 6).alias("mean"))


@query("stream_means", "SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def stream_means(spark, sf_dir):
    """Cell means of the events read as a stream: every batch leaves its sums, which are added up at the end."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path = f"{store.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    sink = Accumulator(f"{path}/sums", [F.col("event_type")], F.col("value").cast("double"), lit(1))
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(*_stream_path(spark, sf_dir))
    source.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start().awaitTermination()
    return sink.means(spark).select(F.col("cell_0").alias("event_type"), F.col("n").cast("long").alias("n"), F.round("mean", 6).alias("mean"))


def _stream_path(spark, sf_dir) -> list[str]:
    """A file stream reads folders, so a table in one file is read through its own name as a pattern."""
    return [f"{sf_dir}/events.parquet*"]


@query("known_binary_truth")
def known_binary_truth(spark, sf_dir):
    """(estimand, psi, std_err, truth) of a binary outcome that is missing at random, on generated data."""
    df, truth = G.missing_outcome_binary(spark, 4000, seed=2)
    f = point_frame(df, PointDesign("Y", "A", "id", ("W1", "W2", "W3"), delta="Delta"))
    r = P.point_tmle(f, ("ey1", "ey0", "ate", "rr", "or"), P.Config())
    return spark.createDataFrame([(e.name, e.psi, e.std_err, truth[e.name]) for e in r.estimates], "estimand string, psi double, std_err double, truth double")


@query("provenance", f"WITH {S.ORDERS} SELECT 7::INTEGER AS seed, 5::INTEGER AS folds, count(*) || ':' || sum(('0x' || substr(md5(id::VARCHAR || chr(31) || a::VARCHAR), 1, 15))::HUGEINT) AS data FROM d0")
def provenance(spark, sf_dir):
    """What a run was made of: settings and a digest of its data."""
    p = store.provenance(orders(spark, sf_dir).select("id", "a"), seed=7, folds=5)
    return spark.createDataFrame([(p["seed"], p["folds"], p["data"])], "seed int, folds int, data string")


@query("multinomial_counts", "SELECT count(*)::BIGINT AS units, count(*)::BIGINT AS draws FROM orders")
def multinomial_counts(spark, sf_dir):
    """Counts with replacement add up to the number of units."""
    df = I.multinomial_weights(orders(spark, sf_dir).withColumn("w", lit(1)), 0)
    return df.agg(F.count("*").alias("units"), F.sum("w").cast("long").alias("draws"))


@query("typed_methods", _ATE)
def typed_methods(spark, sf_dir):
    """A question answered by a method with typed settings."""
    effect = Q.CausalStudy(orders(spark, sf_dir).select("id", "y", "a", "seg"), PointDesign("y", "a", "id", ("seg",))).identify(Q.ATE())
    m = Q.TMLEMethod(outcome_learner="cells", treatment_learner="cells", outcome_cells=(), fluctuation="linear", stratify=False)
    return shown(spark, effect.estimate(m).estimates).select("estimand", "psi", "std_err")
