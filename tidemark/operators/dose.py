"""Continuous doses: a binned conditional density by pooled hazards, and shifts of the dose."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..design import PointFrame
from ..errors import CapabilityError, StudyError
from ..functions.expr import clip, indicator, lit, shrink, total
from .covariate import Component
from .folds import with_folds
from .learn import LogisticNewton, Task, resolve_learner
from .order import quantiles
from .point import Config, Nuisances, Param, Result, Targeted, estimate, released, residual
from .target import Fluctuation, moved, solve_fluctuation


def bin_edges(df: DataFrame, column: str, bins: int = 20) -> list[float]:
    """Equal-mass edges without repetitions; the outer ones are widened so that every dose is inside."""
    if bins < 3:
        raise StudyError("a density needs three bins at least")
    q = quantiles(df, column, [i / bins for i in range(bins + 1)])
    edges = sorted(set(q))
    if len(edges) < 2:
        raise StudyError("the dose is constant")
    pad = 1e-9 * max(1.0, abs(edges[0]), abs(edges[-1]))
    return [edges[0] - pad, *edges[1:-1], edges[-1] + pad]


def bin_of(dose: Column, edges: Sequence[float]) -> Column:
    """The bin's number, from 0; null outside of all bins."""
    inner = total((F.when(dose >= lit(e), lit(1)).otherwise(lit(0)) for e in edges[1:-1]), 0.0)
    return F.when((dose >= lit(edges[0])) & (dose <= lit(edges[-1])), inner.cast("int"))


@dataclass(frozen=True)
class Density:
    """Column ``p_bin`` holds the probabilities of the bins given the covariates."""

    edges: list[float]

    @property
    def widths(self) -> list[float]:
        return list(np.diff(self.edges))

    def at(self, dose: Column) -> Column:
        """Density at a dose; 0 outside the support."""
        b = bin_of(dose, self.edges)
        width = F.element_at(F.array(*(lit(w) for w in self.widths)), b + 1)
        return F.coalesce(F.element_at("p_bin", b + 1) / width, lit(0))


def fit_density(df: DataFrame, features: Sequence[Column], cells: Sequence[Column], *, learner: Any = None, bins: int = 20, edges: Sequence[float] | None = None, folds: int = 0, dose: str = "a") -> tuple[DataFrame, Density]:
    """Add ``p_bin``: one row per unit and bin reached is exploded, a pooled model says who stops there, and the
    hazards become probabilities in log space, the last bin taking what is left.
    """
    edges = list(edges) if edges is not None else bin_edges(df, dose, bins)
    n = len(edges) - 1
    learner = learner or LogisticNewton()
    reached = df.withColumn("bin__own", bin_of(F.col(dose), edges))
    long = reached.withColumn("bin__at", F.explode(F.sequence(F.lit(0), F.least(F.col("bin__own"), F.lit(n - 2)))))
    dummies = [indicator(F.col("bin__at") == b) for b in range(1, n - 1)]
    stop = indicator(F.col("bin__at") == F.col("bin__own"))
    model = learner.fit(long, Task(stop, F.col("w"), None, folds, True), [*dummies, *features], [F.col("bin__at"), *cells])
    out = df
    for b in range(n - 1):
        at = [lit(1.0 if k == b else 0.0) for k in range(1, n - 1)]
        out = model.predict(out, f"haz__{b}", [*at, *features], [F.lit(b), *cells])
    hazards = [clip(F.col(f"haz__{b}"), 1e-12, 1 - 1e-12) for b in range(n - 1)]
    stay = [lit(0)]
    for h in hazards:
        stay.append(stay[-1] + F.log1p(-h))
    p = [F.exp(s + F.log(h)) for s, h in zip(stay, hazards, strict=False)] + [F.exp(stay[-1])]
    return out.withColumn("p_bin", F.array(*p)).drop(*(f"haz__{b}" for b in range(n - 1))), Density(edges)


@dataclass(frozen=True)
class Shift:
    """Move the dose by delta; where that passes the cap, leave it alone."""

    delta: float
    cap: float | None = None

    def apply(self, a: Column) -> Column:
        new = a + lit(self.delta)
        return new if self.cap is None else F.when(new > lit(self.cap), a).otherwise(new)

    def ratio(self, d: Density, a: Column) -> Column:
        """Density of the shifted dose over the density of the dose, at a dose; 0 where the latter is 0."""
        here = d.at(a)
        r = F.when(here > 0, d.at(a - lit(self.delta)) / here).otherwise(lit(0))
        if self.cap is None:
            return r
        return indicator(a <= lit(self.cap)) * r + indicator(a > lit(self.cap - self.delta))


def shift_means(f: PointFrame, shifts: Mapping[str, Shift], config: Config = Config(), *, bins: int = 20, edges: Sequence[float] | None = None, density_learner: Any = None, outcome_features=None, contrasts: bool = True) -> Result:
    """Means under shifts of a continuous dose, each fluctuated in its own component.

    The plug-in reads the targeted regression at the shifted dose, so its curve is not the one of a regime.
    """
    if not f.dose:
        raise CapabilityError("shifts need a continuous dose")
    df = f.df.withColumn("ys", f.scaled())
    if config.folds:
        df = with_folds(df, config.folds, seed=config.seed, cluster="cluster" if f.has_cluster else None)
    x, cells = [F.col(c) for c in f.x], [F.col(c) for c in f.cells]
    df, d = fit_density(df, x, cells, learner=resolve_learner(density_learner or config.treatment_learner, True), bins=bins, edges=edges, folds=config.folds)
    design = outcome_features or (lambda a: ([a, a * a, *x], [a, *cells]))
    q = resolve_learner(config.outcome_learner, False).fit(df, Task(F.col("ys"), F.col("w"), F.col("delta") == 1 if f.has_delta else None, config.folds, f.family == "binomial"), *design(F.col("a")))
    df = q.predict(df, "q_obs", *design(F.col("a")))
    names = list(shifts)
    for i, s in enumerate(shifts.values()):
        df = q.predict(df, f"q_{i}", *design(s.apply(F.col("a"))))
    if config.fluctuation == "logistic":
        df = df.withColumns({c: shrink(F.col(c)) for c in ["q_obs", *(f"q_{i}" for i in range(len(names)))]})
    df = released(df.persist())
    # Component i moves the regression at a dose by the ratio of shift i there, also at the doses that shifts lead to.
    ratios = lambda a: [s.ratio(d, a) for s in shifts.values()]
    at = {i: ratios(s.apply(F.col("a"))) for i, s in enumerate(shifts.values())}
    comps = [Component(m, r, {i: at[i][j] for i in range(len(names))}) for j, (m, r) in enumerate(zip(names, ratios(F.col("a")), strict=True))]
    fl: Fluctuation = solve_fluctuation(df, comps, kind=config.fluctuation, max_iter=config.max_iter, tol=config.tol)
    new = {"qs_obs": moved(F.col("q_obs"), [c.observed for c in comps], fl.epsilon, config.fluctuation)}
    for i in range(len(names)):
        new[f"qs_{i}"] = moved(F.col(f"q_{i}"), [c.at[i] for c in comps], fl.epsilon, config.fluctuation)
    t = Targeted("mtp", df.withColumns(new), comps, fl, None)
    r = residual(t)
    psi = t.df.agg(*(F.sum(F.col("w") * F.col(f"qs_{i}")) / F.sum("w") for i in range(len(names)))).first()
    curve = [F.col("w") * (c.observed * r + F.col(f"qs_{i}") - lit(psi[i])) for i, c in enumerate(comps)]
    params = [Param(f"ey_shift[{m}]", f.low + f.span * psi[i], lit(f.span) * curve[i], "level", "ey_shift", m, axis="shift") for i, m in enumerate(names)]
    if contrasts:
        params += [Param(f"ate_shift[{m} vs {names[0]}]", f.span * (psi[i] - psi[0]), lit(f.span) * (curve[i] - curve[0]), "difference", "ate_shift", m, names[0], axis="shift") for i, m in enumerate(names) if i]
    return estimate(Nuisances(f, t.df, config), {"mtp": (t, params)})


def shift_support(df: DataFrame, d: Density, shifts: Mapping[str, Shift]) -> DataFrame:
    """Per shift: largest ratio, effective size, share shifted out of the support, share that crosses a bin's edge."""
    done = None
    for name, s in shifts.items():
        r, new = s.ratio(d, F.col("a")), s.apply(F.col("a"))
        crossed = indicator(~bin_of(new, d.edges).eqNullSafe(bin_of(F.col("a"), d.edges)))
        part = df.select(r.alias("r"), indicator(d.at(new) == 0).alias("o"), crossed.alias("x"), F.col("w")).agg(
            F.max("r").alias("max_ratio"), F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("r")) ** 2, F.sum((F.col("w") * F.col("r")) ** 2)), lit(0)).alias("effective_n"), F.avg("o").alias("out_of_support"), F.avg("x").alias("crossing")
        )
        part = part.select(F.lit(name).alias("shift"), "*")
        done = part if done is None else done.unionByName(part)
    return done


