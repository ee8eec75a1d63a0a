"""Inference that holds if either side of the nuisances is consistent, with or without missing outcomes.

Beside the usual score every arm gets three more: of the treatment mechanism, of the observation mechanism where
outcomes are missing, and of the outcome regression's drift.  Their covariates are reduced regressions on one
dimension:

    e       the residual on the joint mechanism, among complete rows of the arm
    gamma_a the arm on the outcome regression, gamma_m being observed on it within the arm
    r_a     the relative error of the treatment mechanism on the outcome regression, r_m that of the observation
            mechanism within the arm

Rounds refit the reductions and fluctuate; a closing pass solves all scores again with the reductions held still,
so that the reported curves use the reductions whose scores are zero.  Without missing outcomes the observation
mechanism is one and its score and reductions fall away.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..design import PointFrame
from ..errors import CapabilityError, StudyError
from ..functions.expr import clip, expit, indicator, lit, safe_logit
from ..sources.store import discard, durable
from . import point as P
from .inference import Estimate, covariance
from .learn import FOLD, LinearGram, Task, solve
from .target import moved, solve_fluctuation

GUARDS = ("q", "g")


@dataclass
class GuardedResult(P.Result):
    """A result whose curves carry corrections; ``corrections`` names the columns of ``rows`` that hold them."""

    corrections: dict[str, str] = field(default_factory=dict)
    truncated: float = 0.0
    rounds: int = 0


@dataclass(frozen=True)
class _Arm:
    """Columns of one arm: mechanisms, targeted regression, reductions."""

    k: int
    low: float
    seen_low: float
    missing: bool

    def col(self, name: str) -> Column:
        return F.col(f"{name}_{self.k}")

    @property
    def here(self) -> Column:
        return indicator(F.col("a") == self.k)

    @property
    def complete(self) -> Column:
        return self.here * F.col("delta") if self.missing else self.here

    @property
    def joint(self) -> Column:
        return self.col("ga") * self.col("gm")

    def drift(self) -> Column:
        """What multiplies the residual in the outcome's drift score."""
        a = clip(self.col("gamma_a"), self.low, 1.0)
        m = clip(self.col("gamma_m"), self.seen_low, 1.0) if self.missing else lit(1)
        own = self.col("r_a") / (a * m)
        return own + self.col("r_m") / m if self.missing else own

    def residual(self) -> Column:
        return F.when(F.col("delta") == 1, F.col("ys") - self.col("qs")).otherwise(lit(0))

    def corrections(self, guard: Sequence[str]) -> dict[str, Column]:
        out = {}
        if "q" in guard:
            out["treatment"] = self.col("e") / self.col("ga") * (self.here - self.col("ga"))
            if self.missing:
                out["observation"] = self.here * self.col("e") / self.joint * (F.col("delta") - self.col("gm"))
        if "g" in guard:
            out["outcome"] = self.complete * self.drift() * self.residual()
        return out

    def main(self) -> Column:
        return self.complete / self.joint * self.residual()


def _reductions(arms: Sequence[_Arm]) -> list[str]:
    return [f"{c}_{x.k}" for x in arms for c in ("e", "gamma_a", "gamma_m", "r_a", "r_m")]


def _reduce(df: DataFrame, arms: Sequence[_Arm], learner: Any, folds: int) -> DataFrame:
    """Refit the reductions of every arm at the current mechanisms and regression; a learner with ``fit_all`` does so in one pass."""
    df = df.drop(*_reductions(arms))
    shape = lambda c: [c, c * c]
    todo = []
    for x in arms:
        at = F.col("a") == x.k
        done = at & (F.col("delta") == 1)
        q = x.col("qs")
        parts = [("e", F.col("ys") - q, x.joint, done), ("gamma_a", x.here, q, None), ("r_a", (x.here - x.col("ga")) / x.col("ga"), q, None)]
        if x.missing:
            parts += [("gamma_m", F.col("delta"), q, at), ("r_m", (F.col("delta") - x.col("gm")) / x.joint, q, at)]
        todo += [(f"{name}_{x.k}", on, Task(target, F.col("w"), where, folds)) for name, target, on, where in parts]
    if hasattr(learner, "fit_all"):
        fits = learner.fit_all(df, [(task, shape(on)) for _, on, task in todo])
        return df.withColumns({out: fit.column(shape(on)) for fit, (out, on, _) in zip(fits, todo, strict=True)})
    for out, on, task in todo:
        df = learner.fit(df, task, shape(on), [on]).predict(df, out, shape(on), [on])
    return durable(df, "reduced")


def _steps(df: DataFrame, arms: Sequence[_Arm], guard: Sequence[str], kind: str) -> tuple[float, list]:
    """The largest mean score of any equation over its standard deviation, and what ``_move`` needs for a step of all.

    One pass: scores, a Newton step of every tilt, and a linear fluctuation are sums over the same rows.
    """
    w = F.col("w")
    sums: list[Column] = []

    def ask(*columns: Column) -> slice:
        sums.extend(columns)
        return slice(len(sums) - len(columns), len(sums))

    scored = [ask(F.avg(w * c), F.stddev_pop(w * c)) for x in arms for c in (x.main(), *x.corrections(guard).values())]
    tilts, moves = [], []
    for x in arms:
        if "q" in guard:
            parts = [("ga", x.col("e") / x.col("ga"), x.here, w, x.low)]
            parts += [("gm", x.col("e") / x.joint, F.col("delta"), w * x.here, x.seen_low)] if x.missing else []
            for name, h, hit, v, low in parts:
                g = x.col(name)
                tilts.append((f"{name}_{x.k}", g, h, low, ask(F.sum(v * h * (hit - g)), F.sum(v * h**2 * g * (lit(1) - g)))))
        at = [lit(1) / x.joint] + ([x.drift()] if "g" in guard else [])
        v = F.when(F.col("delta") == 1, w * x.here).otherwise(lit(0))
        upper = np.triu_indices(len(at))
        linear = ask(*(F.sum(v * at[i] * at[j]) for i, j in zip(*upper, strict=True)), *(F.sum(v * h * (F.col("ys") - x.col("qs"))) for h in at)) if kind == "linear" else None
        moves.append((x, at, linear))
    r = list(df.agg(*sums).first())
    worst = max(abs(m or 0.0) / max(sd or 0.0, 1e-12) if (sd or 0.0) > 1e-9 else 0.0 for m, sd in (r[s] for s in scored))
    new = {}
    for name, g, h, low, s in tilts:
        top, under = r[s]
        eps = float(np.clip((top or 0.0) / under, -1, 1)) if under and under > 1e-12 else 0.0
        new[name] = clip(expit(safe_logit(g, 1 - 1e-9) + lit(eps) * h), low, 1.0)
    return worst, [new, moves, r]


def _move(df: DataFrame, arms: Sequence[_Arm], kind: str, step: list) -> DataFrame:
    """Fluctuate both mechanisms and the regression of every arm once, by what ``_steps`` found."""
    new, moves, r = step
    for x, at, linear in moves:
        if linear is None:
            comps = [P.C.Component(str(i), x.here * v, {0: v}) for i, v in enumerate(at)]
            eps = solve_fluctuation(df.withColumn("q_obs", x.col("qs")), comps, kind=kind).epsilon
        else:
            d = len(at)
            flat = np.array([v or 0.0 for v in r[linear]])
            m = np.zeros((d, d))
            m[np.triu_indices(d)] = flat[:-d]
            eps = solve(m + np.triu(m, 1).T, flat[-d:])[None, :]
        new[f"qs_{x.k}"] = moved(x.col("qs"), at, eps, kind)
    return df.select(*(new[c].alias(c) if c in new else F.col(c) for c in df.columns))


def doubly_robust(f: PointFrame, config: P.Config = P.Config(), *, guard: Sequence[str] = GUARDS, rounds: int = 15, tol: float = 1e-6, learner: Any = None, closing: int = 20) -> GuardedResult:
    """Arm means and contrasts with corrected curves; ``guard`` says which nuisance may be wrong.

    ``learner`` fits the reductions on a value and its square, or on the value as a cell; by default least squares.
    With folds in the configuration the reductions are cross-fitted like the nuisances.
    """
    if f.has_intermediate:
        raise CapabilityError("not with an intermediate")
    if f.has_delta and f.arms != 2:
        raise CapabilityError("missing outcomes need a binary treatment here")
    if not guard or not set(guard) <= set(GUARDS):
        raise StudyError(f"guards are among {GUARDS}")
    n = P.fit_nuisances(f, config)
    s = P.setting(n)
    learner = learner or LinearGram()
    arms = [_Arm(k, s.g_low, s.nuisance_low, f.has_delta) for k in range(f.arms)]
    df = n.df.withColumn("ys", F.when(F.col("delta") == 1, F.col("ys")).otherwise(lit(0)))
    raw = [F.abs(F.col(f"g_{x.k}") - s.g(x.k)) > 1e-15 for x in arms]
    truncated = df.agg(F.avg(indicator(F.greatest(*(indicator(c) for c in raw)) > 0))).first()[0]
    df = df.select("id", "cluster", "w", "a", "ys", "delta", *([FOLD] if n.folds else []), *(s.g(x.k).alias(f"ga_{x.k}") for x in arms), *(s.pi(x.k).alias(f"gm_{x.k}") for x in arms), *(F.col(f"q_{x.k}").alias(f"qs_{x.k}") for x in arms))
    kept = durable(df, "guarded")
    n.df.unpersist()  # the table has what is needed

    def advanced(df: DataFrame, step: list, *gone: str) -> DataFrame:
        """The written table after a step; the one before is deleted, so that two exist at most."""
        nonlocal kept
        before, reduced = kept, getattr(df, "_written_to", None)
        kept = durable(_move(df, arms, config.fluctuation, step).drop(*gone), "guarded")
        for old in [before] + ([df] if reduced and df is not before else []):
            discard(old)
        return kept

    df, done = kept, 0
    for done in range(1, rounds + 1):
        df = _reduce(df, arms, learner, n.folds)
        score, step = _steps(df, arms, guard, config.fluctuation)
        if score <= tol:
            break
        df = advanced(df, step, *_reductions(arms))
    else:
        df = _reduce(df, arms, learner, n.folds)
    for _ in range(closing):
        score, step = _steps(df, arms, guard, config.fluctuation)
        if score <= 1e-8:
            break
        df = advanced(df, step)
    names, ref = [str(v) for v in f.levels], config.reference
    sums = df.agg(F.sum("w"), *(F.sum(F.col("w") * x.col("qs")) for x in arms)).first()
    psi = [v / sums[0] for v in sums[1:]]
    found, held = {}, {}
    for x in arms:
        parts = x.corrections(guard)
        curve = x.main() + x.col("qs") - lit(psi[x.k])
        for name, part in parts.items():
            curve = curve - part
            found[f"{name}[{names[x.k]}]"] = F.col("w") * lit(f.span) * part
        held[x.k] = F.col("w") * lit(f.span) * curve
    params = [P.Param(f"ey[{names[k]}]", f.low + f.span * psi[k], held[k], "level", "ey", names[k]) for k in held]
    for k in (k for k in held if k != ref):
        params.append(P.Param(P.label("ate") if f.arms == 2 else P.label("ate", names[k], names[ref]), f.span * (psi[k] - psi[ref]), held[k] - held[ref], "difference", "ate", names[k], names[ref]))
    ics, places = [f"ic_{i}" for i in range(len(params))], {name: f"corr_{i}" for i, name in enumerate(found)}
    rows = df.select("id", "cluster", *(p.ic.alias(c) for p, c in zip(params, ics, strict=True)), *(c.alias(places[k]) for k, c in found.items()))
    means, cov, count = covariance(rows, ics, "cluster" if f.has_cluster else None)
    estimates = [Estimate(p.name, p.psi, math.sqrt(max(cov[i, i], 0)), p.scale, count, config.alpha, p.estimand, p.arm, p.reference) for i, p in enumerate(params)]
    return GuardedResult(f, estimates, cov, rows, ics, means, {}, n, places, float(truncated), done)


def correction_check(result: GuardedResult, gate: float = 1e-3) -> DataFrame:
    """(correction, mean, std_err, solved): the corrections' means, computed again from the rows, against their standard errors."""
    names = list(result.corrections)
    r = result.rows.agg(F.count("*"), *(F.avg(result.corrections[k]) for k in names), *(F.stddev_samp(result.corrections[k]) for k in names)).first()
    rows = []
    for i, k in enumerate(names):
        mean, se = r[1 + i] or 0.0, (r[1 + len(names) + i] or 0.0) / math.sqrt(r[0])
        rows.append((k, mean, se, abs(mean) <= gate * se + 1e-9))  # a correction of nothing is solved
    return result.rows.sparkSession.createDataFrame(rows, "correction string, mean double, std_err double, solved boolean")
