"""Fluctuations: moving the initial regression until the efficient score equations hold.

Every step is one aggregate of a gradient and a Hessian, with a block per fold when each fold gets its own
epsilon; the small systems are solved on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, expit, lit, safe_logit, shrink, total
from .covariate import Component
from .learn import FOLD, solve


@dataclass(frozen=True)
class Fluctuation:
    epsilon: np.ndarray  # folds x components; one row when pooled
    converged: bool
    steps: int
    relative_score: float
    reason: str = ""


def _eps(epsilon: np.ndarray, j: int) -> Column:
    if len(epsilon) == 1:
        return lit(epsilon[0, j])
    return F.element_at(F.array(*(lit(e) for e in epsilon[:, j])), F.col(FOLD) + 1)


def moved(q: Column, h: Sequence[Column], epsilon: np.ndarray, kind: str) -> Column:
    """The regression after the fluctuation."""
    shift = total(_eps(epsilon, j) * x for j, x in enumerate(h))
    return q + shift if kind == "linear" else shrink(expit(safe_logit(q) + shift))


def scores(df: DataFrame, residual: Column, h: Sequence[Column], weight: Column) -> np.ndarray:
    """Means of w h r, then of |w h|, over all rows."""
    r = df.agg(F.count("*"), *(F.sum(weight * x * residual) for x in h), *(F.sum(F.abs(weight * x)) for x in h)).first()
    return np.array([v or 0.0 for v in r[1:]]) / r[0]


def relative(values: np.ndarray) -> float:
    d = len(values) // 2
    return float(np.max(np.abs(values[:d]) / np.maximum(values[d:], 1e-300), initial=0.0))


def solve_fluctuation(df: DataFrame, components: Sequence[Component], *, kind: str = "logistic", weight: Column | None = None, target_weight: Column | None = None, folds: int = 0, max_iter: int = 50, tol: float = 1e-10) -> Fluctuation:
    """Epsilon for a frame with ys, q_obs, delta and w: the score equations of all components at once.

    ``folds`` > 0 solves one epsilon per fold, still in one aggregate per step.
    """
    seen = F.col("delta") == 1
    w = (weight if weight is not None else F.col("w")) * (target_weight if target_weight is not None else lit(1))
    d = len(components)
    rows = df.select(F.col("ys"), F.col("q_obs"), F.when(seen, w).otherwise(lit(0)).alias("v"), *(c.observed.alias(f"h_{j}") for j, c in enumerate(components)), *([F.col(FOLD)] if folds else []))
    h = [F.col(f"h_{j}") for j in range(d)]
    n_models = max(folds, 1)

    def sums(exprs: list[Column]) -> np.ndarray:
        if not folds:
            return np.array([[v or 0.0 for v in rows.agg(*exprs).first()]], float)
        out = np.zeros((folds, len(exprs)))
        for r in rows.groupBy(FOLD).agg(*exprs).collect():
            out[r[0]] = [v or 0.0 for v in r[1:]]
        return out

    upper = np.triu_indices(d)

    def matrix(flat: np.ndarray) -> np.ndarray:
        m = np.zeros((d, d))
        m[upper] = flat
        return m + np.triu(m, 1).T

    eps = np.zeros((n_models, d))
    if kind == "linear":
        r = sums([F.sum(F.col("v") * h[i] * (F.col("ys") - F.col("q_obs"))) for i in range(d)] + [F.sum(F.col("v") * h[i] * h[j]) for i, j in zip(*upper, strict=True)])
        for m in range(n_models):
            eps[m] = solve(matrix(r[m, d:]), r[m, :d])
        return Fluctuation(eps, True, 1, 0.0)
    rows = rows.persist()
    reason, steps, rel = "max_iter", 0, np.inf
    try:
        lik = None
        move = np.zeros_like(eps)
        for steps in range(1, max_iter + 1):
            q = moved(F.col("q_obs"), h, eps, "logistic")
            loss = F.col("v") * (F.col("ys") * F.log(q) + (lit(1) - F.col("ys")) * F.log(lit(1) - q))
            r = sums(
                [F.sum(F.col("v") * h[i] * (F.col("ys") - q)) for i in range(d)]
                + [F.sum(F.abs(F.col("v") * h[i])) for i in range(d)]
                + [F.sum(loss)]
                + [F.sum(F.col("v") * q * (lit(1) - q) * h[i] * h[j]) for i, j in zip(*upper, strict=True)]
            )
            rel = float(np.max(np.abs(r[:, :d]) / np.maximum(r[:, d : 2 * d], 1e-300)))
            now = r[:, 2 * d].sum()
            if rel <= tol:
                reason = ""
                break
            if lik is not None and now < lik - 1e-9 * abs(lik):  # overshot: halve the step
                move = move / 2
                eps = eps - move
                if np.abs(move).max() < 1e-14:
                    reason = "stalled"
                    break
                continue
            lik = now
            for m in range(n_models):
                move[m] = solve(matrix(r[m, 2 * d + 1 :]), r[m, :d])
            if np.abs(move).max() < 1e-15:
                reason = "stalled"
                break
            eps = eps + move
    finally:
        rows.unpersist()
    return Fluctuation(eps, not reason, steps, rel, reason)


def solve_one_step(df: DataFrame, components: Sequence[Component], *, step: float = 1e-2, tol: float = 1e-6, cap: int = 300) -> Fluctuation:
    """Walk along the score direction in small steps, halving on overshoot; a path that is followed to its end."""
    h = [c.observed for c in components]
    weight = F.when(F.col("delta") == 1, F.col("w")).otherwise(lit(0))
    eps, best, size, rel, steps = np.zeros((1, len(h))), np.inf, step, np.inf, 0
    direction = np.zeros(len(h))
    for steps in range(1, cap + 1):
        q = moved(F.col("q_obs"), h, eps, "logistic")
        s = scores(df, F.col("ys") - q, h, weight)
        rel, norm = relative(s), float(np.linalg.norm(s[: len(h)]))
        if rel <= tol or size < 1e-12:
            break
        if norm >= best:
            eps[0] -= size * direction
            size /= 2
        else:
            best = norm
            direction = s[: len(h)] / max(norm, 1e-300)
        eps = eps.copy()
        eps[0] += size * direction
    return Fluctuation(eps, rel <= tol, steps, rel, "" if rel <= tol else "max_iter")


def apply(df: DataFrame, components: Sequence[Component], f: Fluctuation, arms: Sequence[int], kind: str) -> DataFrame:
    """Add qs_obs and qs_k for every arm."""
    new = {"qs_obs": moved(F.col("q_obs"), [c.observed for c in components], f.epsilon, kind)}
    for k in arms:
        new[f"qs_{k}"] = moved(F.col(f"q_{k}"), [c.at[k] for c in components], f.epsilon, kind)
    return df.withColumns(new)


def solve_mechanism(df: DataFrame, covariate: Column, *, treatment: Column | None = None, g: Column | None = None, bounds: tuple[float, float] | None = None, max_iter: int = 50, tol: float = 1e-10) -> float:
    """Epsilon of the tilt expit(logit g + H eps) at which the mean of H (A - g) is zero.

    With ``bounds`` the score is taken at the truncated tilt, whose root is bracketed and bisected.
    """
    a = treatment if treatment is not None else F.col("a")
    g = g if g is not None else F.col("g_1")
    rows = df.select(a.cast("double").alias("t"), g.alias("g"), covariate.alias("h"), F.col("w").alias("v")).persist()

    def at(eps: float) -> tuple[float, float, float]:
        p = expit(safe_logit(F.col("g"), 1 - 1e-9) + lit(eps) * F.col("h"))
        p = clip(p, *bounds) if bounds else p
        r = rows.agg(F.sum(F.col("v") * F.col("h") * (F.col("t") - p)), F.sum(F.col("v") * F.col("h") ** 2 * p * (lit(1) - p)), F.sum(F.abs(F.col("v") * F.col("h")))).first()
        return r[0] or 0.0, r[1] or 0.0, r[2] or 0.0

    try:
        eps = 0.0
        if bounds is None:
            for _ in range(max_iter):
                s, info, scale = at(eps)
                if abs(s) <= tol * max(scale, 1e-300) or info <= 0:
                    break
                eps += float(np.clip(s / info, -5, 5))
            return eps
        low, high = -1.0, 1.0
        while at(low)[0] < 0 and low > -64:
            low *= 2
        while at(high)[0] > 0 and high < 64:
            high *= 2
        for _ in range(max_iter):
            eps = (low + high) / 2
            s, _, scale = at(eps)
            if abs(s) <= tol * max(scale, 1e-300) or high - low < 1e-14:
                break
            low, high = (eps, high) if s > 0 else (low, eps)
        return eps
    finally:
        rows.unpersist()


def tilted(g: Column, covariate: Column, epsilon: float, bounds: tuple[float, float] | None = None) -> Column:
    p = expit(safe_logit(g, 1 - 1e-9) + lit(epsilon) * covariate)
    return clip(p, *bounds) if bounds else p




def solve_armwise_mechanism(df: DataFrame, covariates: Sequence[Column], *, bounds: tuple[float, float], max_iter: int = 50, tol: float = 1e-10) -> list[float]:
    """Epsilon of every arm's own bounded tilt, arms not renormalised: each step of all bisections is one aggregate.

    Arm k's score is the mean of H_k (1[A = k] - g_k) at the truncated tilt of g_k.
    """
    arms = range(len(covariates))
    rows = df.select("a", F.col("w").alias("v"), *(F.col(f"g_{k}") for k in arms), *(h.alias(f"h_{k}") for k, h in enumerate(covariates))).persist()

    def at(eps: Sequence[float]) -> np.ndarray:
        s = [F.sum(F.col("v") * F.col(f"h_{k}") * (F.when(F.col("a") == k, lit(1)).otherwise(lit(0)) - clip(expit(safe_logit(F.col(f"g_{k}"), 1 - 1e-9) + lit(eps[k]) * F.col(f"h_{k}")), *bounds))) for k in arms]
        return np.array([x or 0.0 for x in rows.agg(*s).first()])

    try:
        low, high = np.full(len(arms), -1.0), np.full(len(arms), 1.0)
        for _ in range(6):
            low = np.where(at(low) < 0, low * 2, low)
            high = np.where(at(high) > 0, high * 2, high)
        for _ in range(max_iter):
            middle = (low + high) / 2
            s = at(middle)
            low, high = np.where(s > 0, middle, low), np.where(s > 0, high, middle)
            if (high - low).max() < tol:
                break
        return [float(e) for e in (low + high) / 2]
    finally:
        rows.unpersist()


#: Groups whose mechanism has a score equation too: group -> the covariate of g, from a setting and the targeted frame's columns.
MECHANISMS: dict[str, Callable] = {}


def register_mechanism(group: str, builder: Callable, *, replace: bool = False) -> None:
    """Declare that a group has a mechanism equation, with the covariate that ``builder`` makes."""
    from ..errors import StudyError

    if group in MECHANISMS and not replace:
        raise StudyError(f"the mechanism of {group!r} is registered already")
    MECHANISMS[group] = builder
