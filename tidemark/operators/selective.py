"""Variants that choose the treatment model by what it does for the outcome: collaborative targeting."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..design import PointFrame
from ..errors import CapabilityError, StudyError
from ..functions.expr import clip, indicator, lit, total
from ..sources.store import durable
from . import point as P
from .inference import covariance
from .learn import FOLD, LogisticNewton, Task
from .target import Fluctuation, moved, solve_fluctuation


def _allowed(requested: Sequence[str]) -> None:
    if not set(requested) <= {"ate", "ey", "ey1", "ey0", "rr", "or"}:
        raise CapabilityError("only arm means and their contrasts and ratios")


def _treatment_model(f: PointFrame, df: DataFrame, x: Sequence[Column], folds: int) -> DataFrame:
    """g_k from a logistic model of each arm on these columns, normalised over more than two arms."""
    df = df.drop(*(f"g_{k}" for k in range(f.arms)))
    for k in range(1, f.arms) if f.arms == 2 else range(f.arms):
        g = LogisticNewton().fit(df, Task(indicator(F.col("a") == k), F.col("w"), None, folds, True), x, [])
        df = df.withColumn(f"g_{k}", g.column(x))
    if f.arms == 2:
        return df.withColumn("g_0", lit(1) - F.col("g_1"))
    names = [f"g_{k}" for k in range(f.arms)]
    return df.withColumn("g__sum", total(F.col(c) for c in names)).withColumns({c: F.col(c) / F.col("g__sum") for c in names}).drop("g__sum")


def _held_out_epsilon(n: P.Nuisances, comps: Sequence[P.C.Component], folds: int) -> np.ndarray:
    """One row of epsilons per fold, each solved on the other folds alone."""
    c = n.config
    parts = [solve_fluctuation(n.df.where(F.col(FOLD) != v), comps, kind=c.fluctuation, max_iter=c.max_iter, tol=c.tol).epsilon[0] for v in range(folds)]
    return np.array(parts)


def partial_correlations(df: DataFrame, y: Column, names: Sequence[str], given: Column, weight: Column) -> dict[str, float]:
    """Weighted correlation of each column with the target, both less their regression on one other column: one aggregate."""
    columns = [y, given, *(F.col(c) for c in names)]
    sums = [F.sum(weight)] + [F.sum(weight * c) for c in columns]
    sums += [F.sum(weight * y * y), F.sum(weight * given * given), F.sum(weight * y * given)]
    for c in names:
        sums += [F.sum(weight * F.col(c) ** 2), F.sum(weight * F.col(c) * y), F.sum(weight * F.col(c) * given)]
    r = list(df.agg(*sums).first())
    w, m = r[0], [v / r[0] for v in r[1 : len(columns) + 1]]
    rest = [v / w for v in r[len(columns) + 1 :]]
    corr = lambda xy, xx, yy: xy / math.sqrt(xx * yy) if xx > 1e-300 and yy > 1e-300 else 0.0
    vy, vz, cyz = rest[0] - m[0] ** 2, rest[1] - m[1] ** 2, rest[2] - m[0] * m[1]
    out = {}
    for i, c in enumerate(names):
        mx = m[2 + i]
        vx, cxy, cxz = rest[3 + 3 * i] - mx * mx, rest[4 + 3 * i] - mx * m[0], rest[5 + 3 * i] - mx * m[1]
        xy, xz, yz = corr(cxy, vx, vy), corr(cxz, vx, vz), corr(cyz, vy, vz)
        out[c] = (xy - xz * yz) / math.sqrt(max((1 - xz * xz) * (1 - yz * yz), 1e-300))
    return out


def _ordered_columns(f: PointFrame, order: Sequence[str]) -> list[str]:
    """The columns of a given order, which names covariates as the design does (labels: all their indicators) or columns of ``f.x``."""
    out: dict[str, None] = {}
    for c in order:
        found = [c] if c in f.x else [x for x in f.x if x == f"x_{c}" or x.startswith(f"x_{c}__")]
        if not found and not {f"x_{c}", f"c_{c}"} & set(f.cells):  # a constant covariate has cells but no column
            raise StudyError(f"no covariate {c!r} to order")
        out |= dict.fromkeys(found)
    return list(out)


def collaborative(f: PointFrame, requested: Sequence[str] = ("ate",), config: P.Config = P.Config(), *, strategy: str = "greedy", order: Sequence[str] | str = "logistic", selection_folds: int = 3, loss: str = "squared") -> P.Result:
    """Pick the covariates of the treatment model by what they do for the targeted outcome loss.

    ``greedy`` adds the covariate that lowers the penalised loss most, ``ordered`` takes an order (given, by the
    loss of each covariate alone, or by its partial correlation with the outcome given the treatment; a given order
    names covariates, and those it leaves out are not tried), and
    ``outcome_adaptive`` models the treatment on the outcome predictions alone.  Paths are scored on held-out
    rows: the outcome regression, the treatment model and epsilon of a fold all come from the other folds.  To
    the loss (squared, or minus log-likelihood) come the trace of the curves' covariance and their squared mean.
    """
    _allowed(requested)
    given = None if isinstance(order, str) else _ordered_columns(f, order)
    if loss not in ("squared", "likelihood"):
        raise StudyError(f"unknown loss {loss!r}")
    if strategy == "outcome_adaptive":
        base = P.fit_nuisances(f, config)
        df = durable(_treatment_model(f, base.df, [F.col(f"q_{k}") for k in range(f.arms)], config.folds), "adaptive")
        return P.point_tmle(f, requested, nuisances=P.Nuisances(f, df, config, None, base.fractions))
    if strategy not in ("greedy", "ordered"):
        raise StudyError(f"unknown strategy {strategy!r}")
    inner = replace(config, folds=selection_folds, seed=config.seed + 31, stratify=False, fold_targeting=False, fold_evaluation=False)
    held = P.fit_nuisances(f, inner)
    table = durable(held.df, "selection")
    scores: dict[tuple[str, ...], float] = {}

    def score(chosen: Sequence[str]) -> float:
        """Held-out penalised loss of the targeted regression under this treatment model."""
        key = tuple(sorted(chosen))
        if key not in scores:
            rows = _treatment_model(f, table, [F.col(c) for c in chosen], selection_folds)
            n = P.Nuisances(f, rows, inner, None, held.fractions)
            s = P.setting(n)
            comps = P.C.GROUPS["mean"](s)
            eps = _held_out_epsilon(n, comps, selection_folds)
            new = {"qs_obs": moved(F.col("q_obs"), [c.observed for c in comps], eps, inner.fluctuation)}
            new |= {f"qs_{k}": moved(F.col(f"q_{k}"), [c.at[k] for c in comps], eps, inner.fluctuation) for k in range(f.arms)}
            t = P.Targeted("mean", rows.withColumns(new), comps, Fluctuation(eps, True, 1, 0.0), s)
            ps = P.arm_params(n, t, ("ey",))
            gap = F.col("ys") - F.col("qs_obs")
            p = clip(F.col("qs_obs"), 1e-9, 1 - 1e-9)
            each = gap * gap * lit(f.span**2) if loss == "squared" else -(F.col("ys") * F.log(p) + (lit(1) - F.col("ys")) * F.log(lit(1) - p))
            part = t.df.select("id", *(x.ic.alias(f"ic_{i}") for i, x in enumerate(ps)), (F.col("w") * F.when(F.col("delta") == 1, each)).alias("l"))
            means, cov, count = covariance(part, [f"ic_{i}" for i in range(len(ps))])
            scores[key] = part.agg(F.sum("l")).first()[0] + float(np.trace(cov)) * count + count * float(means @ means)
        return scores[key]

    if isinstance(order, str) and strategy == "ordered":
        if order == "logistic":
            left = sorted(f.x, key=lambda c: (score([c]), c))
        elif order == "partial_correlation":
            r = partial_correlations(f.df.where("delta = 1"), F.col("y"), f.x, F.col("a").cast("double"), F.col("w"))
            left = sorted(f.x, key=lambda c: (-abs(r[c]), c))
        else:
            raise StudyError(f"unknown order {order!r}")
    else:
        left = list(f.x) if given is None else given
    chosen: list[str] = []
    best_path, best = [], score([])
    while left:
        value, pick = min((score([*chosen, c]), c) for c in (left if strategy == "greedy" else left[:1]))
        chosen.append(pick)
        left.remove(pick)
        if value < best:
            best, best_path = value, list(chosen)
        elif strategy == "greedy":
            break
    whole = P.fit_nuisances(f, config)
    df = durable(_treatment_model(f, whole.df, [F.col(c) for c in best_path], config.folds), "chosen")
    return P.point_tmle(f, requested, nuisances=P.Nuisances(f, df, config, None, whole.fractions))
