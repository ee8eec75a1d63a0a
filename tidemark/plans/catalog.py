"""Registered queries of the causal engine and the SQL that checks them.

The tables are synthetic, so effects in them mean nothing; what counts is that two engines agree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..design import PointDesign, point_frame
from ..functions.expr import lit
from ..operators import point as P
from ..operators.folds import hash32
from ..operators.learn import CellMean
from ..sources.store import table
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: y, a, priority, seg, cl, f and h, an even hash of the key."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / lit(1000)).alias("y"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("seg"), F.col("o_custkey").alias("cl"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0).alias("a"), F.when(F.col("o_orderstatus") == "F", lit(1)).otherwise(lit(0)).alias("f"), hash32(F.col("o_orderkey")).alias("h"),
    )


def saturated(**more) -> P.Config:
    """Cell means for every nuisance but a coarse outcome regression, so that targeting has something to do."""
    return P.Config(CellMean(), CellMean(), CellMean(), CellMean(), outcome_cells=(), fluctuation=more.pop("fluctuation", "linear"), stratify=False, **more)


def shown(spark: SparkSession, estimates: Sequence) -> DataFrame:
    rows = [(e.name, e.psi, e.std_err, *e.interval(), e.n) for e in estimates]
    df = spark.createDataFrame(rows, "estimand string, psi double, std_err double, ci_lower double, ci_upper double, n bigint")
    return df.select("estimand", *(F.round(c, 6).alias(c) for c in ("psi", "std_err", "ci_lower", "ci_upper")), "n")


def _study(df: DataFrame, **roles):
    roles = {"outcome": "y", "treatment": "a", "id": "id", "covariates": ("seg",)} | roles
    keep = {c for v in roles.values() for c in ([v] if isinstance(v, str) else v) if c in df.columns}
    return point_frame(df.select(*sorted(keep)), PointDesign(**roles))


_BASIC = ("ey1", "ey0", "ate", "ey_obs", "par")


@query("ate_targeted", S.query(S.base(), S.nuisances(2), S.linear_means(2), S.curves(2), final=S.report(S.arm_rows(_BASIC))))
def ate_targeted(spark, sf_dir):
    """Means, contrast and attributable difference of urgent orders, with a linear fluctuation."""
    return shown(spark, P.point_tmle(_study(orders(spark, sf_dir)), _BASIC, saturated()).estimates)


_LOGIT_Y = S.base("(y - lo) / (hi - lo)").replace("FROM d0)", "FROM d0, (SELECT min(y) - 0.1e0 * (max(y) - min(y)) AS lo, max(y) + 0.1e0 * (max(y) - min(y)) AS hi FROM d0) b)").replace("AS fold FROM", "AS fold, lo, hi - lo AS span FROM")


@query("ate_logistic", S.query(_LOGIT_Y, S.nuisances(2), S.logistic_means(2), S.curves(2), final=S.report([("ey1", "lo + span * m1", "span * d1", "level"), ("ey0", "lo + span * m0", "span * d0", "level"), ("ate", "span * (m1 - m0)", "span * (d1 - d0)", "difference")])))
def ate_logistic(spark, sf_dir):
    """The same means with a logistic fluctuation of the outcome scaled to its widened range."""
    return shown(spark, P.point_tmle(_study(orders(spark, sf_dir)), ("ey1", "ey0", "ate"), saturated(fluctuation="logistic")).estimates)


_BINARY = ("ey1", "ey0", "ate", "rr", "or", "paf", "par", "ey_obs")


@query("binary_outcome", S.query(S.base("f"), S.nuisances(2), S.linear_means(2), S.curves(2), final=S.report(S.arm_rows(_BINARY))))
def binary_outcome(spark, sf_dir):
    """Risk and odds ratios and the attributable fraction of a binary outcome."""
    return shown(spark, P.point_tmle(_study(orders(spark, sf_dir), outcome="f"), _BINARY, saturated()).estimates)


@query("binary_logistic", S.query(S.base("f"), S.nuisances(2), S.logistic_means(2), S.curves(2), final=S.report(S.arm_rows(("ate", "rr", "or")))))
def binary_logistic(spark, sf_dir):
    return shown(spark, P.point_tmle(_study(orders(spark, sf_dir), outcome="f"), ("ate", "rr", "or"), saturated(fluctuation="logistic")).estimates)


@query("weighted", S.query(S.base(w="0.7e0 * (1 + id % 3)"), S.nuisances(2), S.linear_means(2), S.curves(2), final=S.report(S.arm_rows(_BASIC))))
def weighted(spark, sf_dir):
    """Sampling weights tilt the population: they enter nuisances, scores, means and curves."""
    df = orders(spark, sf_dir).withColumn("w0", lit(0.7) * (1 + F.col("id") % 3))
    return shown(spark, P.point_tmle(_study(df, weights="w0"), _BASIC, saturated()).estimates)


@query("clustered", S.query(S.base(), S.nuisances(2), S.linear_means(2), S.curves(2), final=S.report(S.arm_rows(_BASIC), cluster=True)))
def clustered(spark, sf_dir):
    """Standard errors from curves summed by customer."""
    return shown(spark, P.point_tmle(_study(orders(spark, sf_dir), cluster="cl"), _BASIC, saturated()).estimates)


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_CODE = "CASE priority " + " ".join(f"WHEN '{v}' THEN {k}" for k, v in enumerate(_PRIORITIES)) + " END"


@query("multi_arm", S.query(S.base(a=_CODE), S.nuisances(5), S.linear_means(5), S.curves(5), final=S.report(S.arm_rows(("ey", "ate"), _PRIORITIES))))
def multi_arm(spark, sf_dir):
    """Five arms: every mean, and contrasts with the first."""
    return shown(spark, P.point_tmle(_study(orders(spark, sf_dir), treatment="priority"), ("ey", "ate"), saturated()).estimates)


def _conditional_sql(arm: int) -> str:
    g = "least(greatest(g1, 0.025e0), 0.975e0)"
    up, down = ("1e0 / pa", f"({g} / (1e0 - {g})) / pa") if arm == 1 else (f"((1e0 - {g}) / {g}) / pa", "1e0 / pa")
    return f"""x0 AS (SELECT *, sum(CASE WHEN a = {arm} THEN w ELSE 0e0 END) OVER () / n AS pa FROM u),
x1 AS (SELECT *, {up} AS hu, {down} AS hd FROM x0),
x2 AS (SELECT *, CASE WHEN a = 1 THEN hu ELSE -hd END AS ho FROM x1),
xe AS (SELECT sum(w * ho * (y - qo)) / sum(w * ho * ho) AS eps FROM x2),
x3 AS (SELECT x2.*, q1 + eps * hu AS s1, q0 - eps * hd AS s0, qo + eps * ho AS so FROM x2, xe),
xm AS (SELECT sum(CASE WHEN a = {arm} THEN w * (s1 - s0) ELSE 0e0 END) / sum(CASE WHEN a = {arm} THEN w ELSE 0e0 END) AS psi FROM x3),
c AS (SELECT x3.*, psi, w * (ho * (y - so) + CASE WHEN a = {arm} THEN 1e0 ELSE 0e0 END / pa * (s1 - s0 - psi)) AS ic FROM x3, xm)"""


@query("att", S.query(S.base(), S.nuisances(2), _conditional_sql(1), final=S.report([("att", "psi", "ic", "difference")])))
def att(spark, sf_dir):
    return shown(spark, P.point_tmle(_study(orders(spark, sf_dir)), ("att",), saturated()).estimates)


@query("atc", S.query(S.base(), S.nuisances(2), _conditional_sql(0), final=S.report([("atc", "psi", "ic", "difference")])))
def atc(spark, sf_dir):
    return shown(spark, P.point_tmle(_study(orders(spark, sf_dir)), ("atc",), saturated()).estimates)


@query("missing_outcome", S.query(S.base(delta="CASE WHEN h % 4 = 0 THEN 0 ELSE 1 END"), S.nuisances(2, delta=True), S.linear_means(2), S.curves(2), final=S.report(S.arm_rows(("ey1", "ey0", "ate")))))
def missing_outcome(spark, sf_dir):
    """A quarter of the outcomes unobserved: the observation mechanism enters the covariate."""
    df = orders(spark, sf_dir).withColumn("delta", F.when(F.col("h") % 4 == 0, 0).otherwise(1))
    return shown(spark, P.point_tmle(_study(df, delta="delta"), ("ey1", "ey0", "ate"), saturated()).estimates)


def _direct(z: int) -> str:
    return S.query(S.base(z="f"), S.nuisances(2, z=z), S.linear_means(2), S.curves(2), final=S.report(S.arm_rows(("ey1", "ey0", "ate"))))


@query("direct_effect_z1", _direct(1))
def direct_effect_z1(spark, sf_dir):
    """Controlled direct effect with the intermediate fixed at 1."""
    return shown(spark, P.point_tmle(_study(orders(spark, sf_dir), intermediate="f"), ("ey1", "ey0", "ate"), saturated(), z=1).estimates)


@query("direct_effect_z0", _direct(0))
def direct_effect_z0(spark, sf_dir):
    return shown(spark, P.point_tmle(_study(orders(spark, sf_dir), intermediate="f"), ("ey1", "ey0", "ate"), saturated(), z=0).estimates)


@query("cross_fit", S.query(S.base(folds=5), S.nuisances(2, folds=5, q_cells=("seg",)), S.linear_means(2), S.curves(2), final=S.report(S.arm_rows(_BASIC))))
def cross_fit(spark, sf_dir):
    """Out-of-fold cell means for every nuisance, one epsilon for all rows."""
    return shown(spark, P.point_tmle(_study(orders(spark, sf_dir)), _BASIC, P.Config(CellMean(), CellMean(), folds=5, stratify=False, fluctuation="linear")).estimates)


@query("fold_targeted", S.query(S.base(folds=5), S.nuisances(2, folds=5, q_cells=("seg",)), S.linear_means_by_fold(2), S.curves(2), final=S.report(S.arm_rows(("ey1", "ey0", "ate")))))
def fold_targeted(spark, sf_dir):
    """One epsilon per fold."""
    return shown(spark, P.point_tmle(_study(orders(spark, sf_dir)), ("ey1", "ey0", "ate"), P.Config(CellMean(), CellMean(), folds=5, stratify=False, fluctuation="linear", fold_targeting=True)).estimates)


@query(
    "fold_evaluated",
    S.query(
        S.base(folds=5), S.nuisances(2, folds=5, q_cells=("seg",)), S.linear_means_by_fold(2),
        "f0 AS (SELECT fold, sum(w * (s1 - s0)) / sum(w) AS pv, count(*) AS nv FROM t GROUP BY fold)",
        "f1 AS (SELECT t.fold, pv, nv, w * (CASE WHEN a = 1 THEN p1 ELSE -p0 END * (y - so) + s1 - s0 - pv) AS ic FROM t JOIN f0 USING (fold))",
        "f2 AS (SELECT fold, any_value(pv) AS pv, sum(ic * ic) / (any_value(nv) * any_value(nv)) AS v, count(*) AS k FROM f1 GROUP BY fold)",
        "f3 AS (SELECT avg(pv) AS psi, sqrt(sum(v)) / count(*) AS se, sum(k)::BIGINT AS n FROM f2)",
        final=f"SELECT 'ate' AS estimand, round(psi, 6) AS psi, round(se, 6) AS std_err, round(psi - {S.Z975} * se, 6) AS ci_lower, round(psi + {S.Z975} * se, 6) AS ci_upper, n FROM f3",
    ),
)
def fold_evaluated(spark, sf_dir):
    """Average of the folds' own estimates, with the cross-validated variance."""
    n = P.fit_nuisances(_study(orders(spark, sf_dir)), P.Config(CellMean(), CellMean(), folds=5, stratify=False, fluctuation="linear", fold_targeting=True))
    return shown(spark, [P.fold_evaluated_ate(n)])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog_more, catalog_rest, catalog_reports  # noqa: F401, I001  (register the rest; reports adds SQL to earlier ones)

    return QUERIES


def oracle_sql() -> dict[str, str]:
    from . import catalog_more, catalog_rest, catalog_reports  # noqa: F401, I001

    return SQL
