"""How far an estimate is from being explained away: omitted variables, E-values, missing-not-at-random tilts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CapabilityError
from ..functions.expr import expit, indicator, lit, safe_logit
from .inference import Estimate
from .point import Nuisances, Targeted, residual


@dataclass(frozen=True)
class Elements:
    """Outcome variance, squared norm of the representer, the bound sqrt of their product, and moments of their curves.

    ``v`` holds the covariances of the estimate's curve and the bound's curve, so a bound's standard error is a
    quadratic in its strength.
    """

    psi: float
    sigma2: float
    nu2: float
    max_bias: float
    v: np.ndarray
    n: int


def representer(n: Nuisances, t: Targeted, parameter: str = "ate", arm: int = 1) -> tuple[Column, Column, Column]:
    """(alpha at the row, the functional applied to alpha, the functional applied to the regression) of a parameter.

    ``ate`` and ``ey`` read the arm means' targeting, ``att`` and ``atc`` their own.
    """
    ref = n.config.reference
    q = lambda k: F.col(f"qs_{k}")
    if parameter == "ate":
        return t.components[arm].observed - t.components[ref].observed, t.components[arm].at[arm] + t.components[ref].at[ref], q(arm) - q(ref)
    if parameter == "ey":
        return t.components[arm].observed, t.components[arm].at[arm], q(arm)
    if parameter in ("att", "atc"):
        if t.group != parameter or n.frame.arms != 2:
            raise CapabilityError(f"{parameter} needs its own targeting of two arms")
        own = arm if parameter == "att" else ref
        inside = indicator(F.col("a") == own) / lit(n.fractions[own])
        (c,) = t.components
        return c.observed, inside * (c.at[arm] - c.at[ref]), inside * (q(arm) - q(ref))
    raise CapabilityError(f"no representer of {parameter!r}")


def elements(n: Nuisances, t: Targeted, treated: int = 1, parameter: str = "ate") -> Elements:
    """For a contrast of two arm means, a level or a conditional effect: one aggregate of moments and one of curves."""
    span = n.frame.span
    ho, m, mapped = representer(n, t, parameter, treated)
    r = lit(span) * residual(t)
    w, nu = F.col("w"), lit(2) * m - ho * ho
    diff = lit(span) * mapped
    a = t.df.agg(F.sum(w * r * r), F.sum(F.col("w") * F.when(F.col("delta") == 1, 1).otherwise(0)), F.sum(w * nu), F.sum(w), F.sum(w * diff)).first()
    sigma2, nu2, psi = a[0] / a[1], a[2] / a[3], a[4] / a[3]
    bias = math.sqrt(max(sigma2 * nu2, 0.0))
    inside = lit(1)
    if parameter in ("att", "atc"):  # the estimate is a mean over an arm, whose share is estimated too
        own = treated if parameter == "att" else n.config.reference
        inside = indicator(F.col("a") == own) / lit(n.fractions[own])
    ic = w * (ho * r + diff - inside * lit(psi))
    ic_b = (lit(sigma2) * w * (nu - lit(nu2)) + lit(nu2) * w * (r * r - lit(sigma2))) / lit(2 * max(bias, 1e-300))
    c = t.df.select(ic.alias("x"), ic_b.alias("y")).agg(F.count("*"), F.var_samp("x"), F.covar_samp("x", "y"), F.var_samp("y")).first()
    return Elements(psi, sigma2, nu2, bias, np.array([[c[1], c[2]], [c[2], c[3]]]) / c[0], c[0])


def strength(cf_y: float, cf_d: float, rho: float = 1.0) -> float:
    return abs(rho) * math.sqrt(cf_y * cf_d / (1 - cf_d))


def omitted_variable_bounds(e: Elements, *, cf_y: float = 0.03, cf_d: float = 0.03, rho: float = 1.0, level: float = 0.95) -> dict[str, float]:
    """The range of the estimate under a confounder of this strength, with one-sided confidence bounds."""
    s, z = strength(cf_y, cf_d, rho), NormalDist().inv_cdf(level)
    se = lambda sign: math.sqrt(max(e.v[0, 0] + 2 * sign * s * e.v[0, 1] + s * s * e.v[1, 1], 0.0))
    low, high = e.psi - s * e.max_bias, e.psi + s * e.max_bias
    return {"theta_lower": low, "theta_upper": high, "ci_lower": low - z * se(-1), "ci_upper": high + z * se(1)}


def robustness_value(e: Elements, *, null: float = 0.0, rho: float = 1.0, level: float | None = None) -> float:
    """The common strength cf_y = cf_d at which the bound (with a level, its confidence bound) meets the null."""

    def gap(c: float) -> float:
        b = omitted_variable_bounds(e, cf_y=c, cf_d=c, rho=rho, level=level or 0.5)
        side = ("ci_lower", "ci_upper") if level else ("theta_lower", "theta_upper")
        return b[side[0]] - null if e.psi > null else null - b[side[1]]

    if gap(0.0) <= 0:
        return 0.0
    low, high = 0.0, 0.9999
    if gap(high) > 0:
        return high
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if gap(mid) > 0 else (low, mid)
    return (low + high) / 2


def contour(spark, e: Elements, *, grid: int = 11, top: float = 0.15, rho: float = 1.0) -> DataFrame:
    """(cf_d, cf_y, theta_lower, theta_upper) over a square grid."""
    axis = spark.range(grid).select((F.col("id") * lit(top / (grid - 1))).alias("v"))
    both = axis.select(F.col("v").alias("cf_d")).crossJoin(F.broadcast(axis.select(F.col("v").alias("cf_y"))))  # grid * grid rows
    s = lit(abs(rho)) * F.sqrt(F.col("cf_y") * F.col("cf_d") / (lit(1) - F.col("cf_d")))
    return both.select("cf_d", "cf_y", (lit(e.psi) - s * lit(e.max_bias)).alias("theta_lower"), (lit(e.psi) + s * lit(e.max_bias)).alias("theta_upper"))


def benchmark(full: Elements, short: Elements) -> dict[str, float]:
    """Strengths that leaving out known covariates shows: from a fit with and one without them."""
    cf_y = max((short.sigma2 - full.sigma2) / short.sigma2, 0.0)
    cf_d = max((full.nu2 - short.nu2) / full.nu2, 0.0)
    change = short.psi - full.psi
    scale = math.sqrt(max((short.sigma2 - full.sigma2) * (full.nu2 - short.nu2), 0.0))
    return {"cf_y": cf_y, "cf_d": cf_d, "rho": max(-1.0, min(1.0, change / scale)) if scale > 0 else 0.0, "change": change}


def evalue_from_rr(rr: float) -> float:
    rr = 1 / rr if rr < 1 else rr
    return rr + math.sqrt(rr * (rr - 1))


def evalue(e: Estimate, *, baseline: float | None = None, sd: float | None = None) -> dict[str, float]:
    """E-values of the estimate and of the nearer end of its interval.

    Odds ratios count by their root, differences of a binary outcome from a baseline risk, and those of a
    continuous one by its standard deviation.
    """
    low, high = e.interval()
    if e.scale == "ratio":
        root = 0.5 if e.estimand == "or" else 1.0
        rr, lo, hi = (x**root for x in (e.psi, low, high))
    elif baseline is not None:
        rr, lo, hi = ((baseline + x) / baseline for x in (e.psi, low, high))
    elif sd is not None:
        rr, lo, hi = (math.exp(0.91 * x / sd) for x in (e.psi, low, high))
    else:
        raise CapabilityError("a difference needs a baseline risk or a standard deviation")
    near = max(lo, 1.0) if rr >= 1 else min(hi, 1.0)
    return {"evalue": evalue_from_rr(rr), "evalue_ci": evalue_from_rr(near)}


def missingness_tilt(n: Nuisances, t: Targeted, gammas: Sequence[float], arm_gamma: Sequence[float] | None = None) -> DataFrame:
    """(gamma, ate) if unobserved outcomes had their odds multiplied by exp(gamma): all grid points in one aggregate."""
    if not n.frame.has_delta:
        raise CapabilityError("no outcome is missing")
    f, ref = n.frame, n.config.reference
    turn = list(arm_gamma) if arm_gamma else [1.0] * f.arms
    tilt = lambda k, g: F.col(f"pi_{k}") * F.col(f"qs_{k}") + (lit(1) - F.col(f"pi_{k}")) * expit(safe_logit(F.col(f"qs_{k}"), 1 - 1e-12) + lit(g * turn[k]))
    k = 1 if ref == 0 else 0
    r = t.df.agg(*(F.sum(F.col("w") * (tilt(k, g) - tilt(ref, g))) / F.sum("w") for g in gammas)).first()
    return t.df.sparkSession.createDataFrame([(float(g), f.span * v) for g, v in zip(gammas, r, strict=True)], "gamma double, ate double")


def tipping_gamma(n: Nuisances, t: Targeted, *, null: float = 0.0, search: tuple[float, float] = (-8.0, 8.0), arm_gamma: Sequence[float] | None = None) -> float | None:
    """The smallest |gamma| at which the tilted contrast meets the null; each step asks for a grid at once."""
    at = lambda gs: [r["ate"] - null for r in missingness_tilt(n, t, gs, arm_gamma).orderBy("gamma").collect()]
    low, high = search
    best = None
    for side in ((0.0, high), (low, 0.0)):
        a, b = side
        for _ in range(6):
            grid = list(np.linspace(a, b, 17))
            v = at(grid)
            cross = [i for i in range(16) if v[i] == 0 or v[i] * v[i + 1] < 0]
            if not cross:
                a = b = float("nan")
                break
            i = cross[0] if side[0] == 0.0 else cross[-1]
            a, b = grid[i], grid[i + 1]
        if not math.isnan(a) and (best is None or abs((a + b) / 2) < abs(best)):
            best = float((a + b) / 2)
    return best
