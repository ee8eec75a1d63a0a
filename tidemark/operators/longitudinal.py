"""Sequential-regression engine for regimens over time.

The frame stays wide: masks, cumulative mechanisms and carried outcomes are chained columns of one lazy plan.
Treatment and censoring models are fitted once per time and shared by all regimens, causes and horizons.  With
folds every regression predicts a row from the other folds, and one epsilon is solved for all rows.  What a
regimen's fit leaves is numbers and small tables, so its columns can be added to the mechanism table anew: each
cell is fitted on that table alone, and all curves are read in one pass at the end.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..design import LongitudinalFrame, levels_of
from ..errors import CapabilityError, StudyError
from ..functions.expr import clip, expit, indicator, lit, safe_logit, shrink
from ..sources.store import durable
from .folds import with_folds
from .inference import Estimate, coefficient_frame, covariance
from .learn import FOLD, CellMean, LinearGram, LogisticNewton, Task, solve
from .point import _LINKS

G_BOUNDS = (0.01, 1.0)


@dataclass(frozen=True)
class Regimen:
    """A plan: one arm per time, or a function of the history's columns giving the arm as a column."""

    label: str
    values: tuple[int | str | Callable[[], Column], ...]

    def arm(self, f: LongitudinalFrame, t: int) -> Column:
        """The assigned arm's number; a function gives it itself, a label is looked up."""
        v = self.values[t - 1]
        return v().cast("double") if callable(v) else lit(f.code(t, v))


def resolve_regimens(spec: Mapping[str, Sequence] | Sequence[Regimen], times: int) -> list[Regimen]:
    out = [Regimen(k, tuple(v)) for k, v in spec.items()] if isinstance(spec, Mapping) else list(spec)
    if not out or len({r.label for r in out}) != len(out):
        raise StudyError("regimens need labels of their own")
    if any(len(r.values) != times for r in out):
        raise StudyError("a regimen gives one arm per time")
    return out


def uncensored(t: int) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"c_{s}") == 1 for s in range(1, t + 1)), F.lit(True))


def followed(label: str, t: int) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"a_{s}") == F.col(f"d_{label}_{s}") for s in range(1, t + 1)), F.lit(True))


def event_by(f: LongitudinalFrame, t: int, cause: int | None = None) -> Column:
    """Has an event (of one cause) happened at or before t?"""
    if f.design.kind == "mean" or t < 1:
        return F.lit(False)
    js = range(len(f.design.causes)) if cause is None else (cause,)
    return reduce(lambda a, b: a | b, (F.col(f"e_{j}_{t}") == 1 for j in js), F.lit(False))


def at_risk(f: LongitudinalFrame, label: str, t: int) -> Column:
    return F.coalesce(uncensored(t - 1) & followed(label, t - 1) & ~event_by(f, t - 1), F.lit(False))


def following(f: LongitudinalFrame, label: str, t: int) -> Column:
    """Followed the plan and seen through t; an event at t itself belongs to this time's regression."""
    return F.coalesce(uncensored(t) & followed(label, t) & ~event_by(f, t - 1), F.lit(False))


def with_plans(f: LongitudinalFrame, plans: Sequence[Regimen]) -> DataFrame:
    """Evaluate every rule once: columns d_{label}_t."""
    return f.df.withColumns({f"d_{p.label}_{t}": p.arm(f, t) for p in plans for t in range(1, f.design.times + 1)})


@dataclass
class Settings:
    outcome: Any = field(default_factory=CellMean)
    pseudo: Any = field(default_factory=CellMean)
    treatment: Any = field(default_factory=CellMean)
    censoring: Any = field(default_factory=CellMean)
    fluctuation: str = "linear"
    g_bounds: tuple[float, float] = G_BOUNDS
    alpha: float = 0.05
    coarse: bool = False
    """Regress outcomes on nothing but the intercept: a check that targeting does its work."""
    folds: int = 0
    seed: int = 0

    @classmethod
    def smooth(cls, **more: Any) -> Settings:
        return cls(LogisticNewton(), LinearGram(), LogisticNewton(), LogisticNewton(), "logistic", **more)


def _history(f: LongitudinalFrame, t: int) -> list[Column]:
    return [F.coalesce(F.col(c), lit(0)) for c in f.history[t - 1]]


def fit_mechanism(f: LongitudinalFrame, df: DataFrame, plans: Sequence[Regimen], s: Settings) -> DataFrame:
    """Add cum_{label}_t: the bounded product of treatment and censoring probabilities along each plan."""
    d = f.design
    running = {p.label: lit(1) for p in plans}
    out = df
    for t in range(1, d.times + 1):
        past = [F.coalesce(F.col(f"a_{k}"), lit(0)) for k in range(1, t)]
        here = F.coalesce(uncensored(t - 1) & ~event_by(f, t - 1), F.lit(False))
        features = [*_history(f, t), *past]
        levels = levels_of(out.where(here), f"a_{t}")
        models = {v: s.treatment.fit(out, Task(indicator(F.col(f"a_{t}") == v), F.col("w"), here, s.folds, True), features, features) for v in levels}
        if d.censoring:
            own = [*features, F.coalesce(F.col(f"a_{t}"), lit(0))]
            stay = s.censoring.fit(out, Task(F.col(f"c_{t}"), F.col("w"), here, s.folds, True), own, own)
        for p in plans:
            assigned = [F.col(f"d_{p.label}_{k}") for k in range(1, t)]
            given = [*_history(f, t), *assigned]
            for v, m in models.items():
                out = m.predict(out, f"gt__{int(v)}", given, given)
            g = reduce(lambda a, b: a.when(b[0], b[1]), [(F.col(f"d_{p.label}_{t}") == v, F.col(f"gt__{int(v)}")) for v in levels[1:]], F.when(F.col(f"d_{p.label}_{t}") == levels[0], F.col(f"gt__{int(levels[0])}")))
            step = F.coalesce(g, lit(0))
            if d.censoring:
                whole = [*given, F.col(f"d_{p.label}_{t}")]
                out = stay.predict(out, "ct__", whole, whole)
                step = step * F.col("ct__")
            out = out.withColumn(f"raw_{p.label}_{t}", running[p.label] * step)
            running[p.label] = F.col(f"raw_{p.label}_{t}")
            out = out.withColumn(f"cum_{p.label}_{t}", clip(F.col(f"raw_{p.label}_{t}"), *s.g_bounds))
            out = out.drop(*(f"gt__{int(v)}" for v in levels), "ct__")
        if t % 3 == 0 or t == d.times:  # the plan of a few times is short enough for one pass
            out = durable(out, f"mechanism-{t}")
    return out


@dataclass
class Cell:
    """One regimen, cause and horizon: value, curve column, epsilon by time, and what each time's regression left.

    ``nodes`` holds by time (followers, mean of the weighted score, its standard error, squared error before and
    after targeting); ``add`` puts the curve on the mechanism table.
    """

    label: str
    cause: int
    horizon: int
    psi: float
    ic: str
    epsilon: dict[int, float]
    nodes: dict[int, tuple[int, float, float, float, float]] = field(default_factory=dict)
    add: Callable[[DataFrame], DataFrame] | None = None


def _pseudo(f: LongitudinalFrame, t: int, cause: int, carried: Column) -> Column:
    """What a follower's outcome is at time t: an event now, or what is carried back from later."""
    if f.design.kind == "mean":
        return carried
    return indicator(event_by(f, t, cause)) + indicator(~event_by(f, t)) * carried


def _end(f: LongitudinalFrame) -> Column:
    return lit(0) if f.design.kind != "mean" else F.coalesce((F.col("y") - lit(f.low)) / lit(f.high - f.low), lit(0.5))


def _regress(f: LongitudinalFrame, df: DataFrame, s: Settings, t: int, horizon: int, follow: Column, z: str, q: str) -> Callable[[DataFrame], DataFrame]:
    """Fit column ``z`` among followers on the history; what is returned adds the prediction as column ``q``."""
    features = [] if s.coarse else _history(f, t)
    learner = s.outcome if t == horizon else s.pseudo
    model = learner.fit(df, Task(F.col(z), F.col("w"), follow, s.folds, t == horizon), features, features)
    return lambda d: model.predict(d, q, features, features)


def fit_cell(f: LongitudinalFrame, df: DataFrame, p: Regimen, cause: int, horizon: int, s: Settings) -> Cell:
    """Backwards over the times: regress among followers, fluctuate the intercept with loss weight w / cum, carry on."""
    tag = f"{p.label}_{cause}_{horizon}"
    span = f.high - f.low
    carried = _end(f)
    steps: list[Callable[[DataFrame], DataFrame]] = []
    terms, epsilon, facts = [], {}, []
    begin = df
    for t in range(horizon, 0, -1):
        follow, risk = following(f, p.label, t), at_risk(f, p.label, t)
        zt, qt, st = (f"{c}_{tag}_{t}" for c in "zqs")
        now = F.when(follow, _pseudo(f, t, cause, carried))
        put = lambda d, zt=zt, now=now: d.withColumn(zt, now)
        df = put(df)
        predict = _regress(f, df, s, t, horizon, follow, zt, qt)
        df = predict(df)
        target, q = F.col(zt), F.col(qt)
        weight = F.when(follow, F.col("w") / F.col(f"cum_{p.label}_{t}"))
        if s.fluctuation == "linear":
            r = df.agg(F.sum(weight * (target - q)), F.sum(weight)).first()
            eps = (r[0] or 0.0) / (r[1] or 1.0)
            new = q + lit(eps)
        else:
            eps, q = 0.0, shrink(q)
            for _ in range(30):
                moved = expit(safe_logit(q) + lit(eps))
                r = df.agg(F.sum(weight * (target - moved)), F.sum(weight * moved * (lit(1) - moved))).first()
                step = (r[0] or 0.0) / max(r[1] or 0.0, 1e-300)
                eps += max(-5.0, min(5.0, step))
                if abs(step) < 1e-12:
                    break
            new = expit(safe_logit(q) + lit(eps))
        epsilon[t] = eps
        settle = lambda d, st=st, risk=risk, new=new: d.withColumn(st, F.when(risk, new))
        df = settle(df)
        steps += [put, predict, settle]
        carried = F.coalesce(F.col(st), lit(0.5))
        terms.append(F.when(follow, (target - F.col(st)) / F.col(f"cum_{p.label}_{t}")).otherwise(lit(0)))
        inside = F.when(follow, F.col("w"))
        score = F.col("w") * terms[-1]
        facts += [F.sum(indicator(follow)), F.avg(score), F.stddev_samp(score) / F.sqrt(F.count("*")), F.sum(inside * (target - q) ** 2) / F.sum(inside), F.sum(inside * (target - F.col(st)) ** 2) / F.sum(inside)]
    first = F.col(f"s_{tag}_1")
    r = df.agg(F.sum(F.col("w") * first) / F.sum("w"), *facts).first()
    nodes = {t: (int(r[1 + 5 * i]), *(float(v or 0.0) for v in r[2 + 5 * i : 6 + 5 * i])) for i, t in enumerate(range(horizon, 0, -1))}
    ic = lit(span) * F.col("w") * (first - lit(r[0]) + reduce(lambda a, b: a + b, terms))
    kept = begin.columns

    def add(d: DataFrame) -> DataFrame:
        out = d
        for step in steps:
            out = step(out)
        return out.select(*kept, *(c for c in d.columns if c not in kept), ic.alias(f"ic_{tag}"))

    return Cell(p.label, cause, horizon, f.low + span * r[0], f"ic_{tag}", epsilon, nodes, add)


@dataclass
class LongitudinalResult:
    frame: LongitudinalFrame
    df: DataFrame
    cells: list[Cell]
    means: list[Estimate]
    contrasts: list[Estimate]
    cov: np.ndarray
    plans: list[Regimen]

    def scores(self, gate: float = 1e-3) -> DataFrame:
        """(regimen, cause, horizon, time, followers, score, std_err, solved): the mean weighted score of every regression after targeting."""
        rows = [(c.label, self.frame.design.causes[c.cause], c.horizon, t, v[0], v[1], v[2], abs(v[1]) <= gate * v[2] + 1e-12) for c in self.cells for t, v in sorted(c.nodes.items())]
        return self.df.sparkSession.createDataFrame(rows, "regimen string, cause string, horizon int, time int, followers long, score double, std_err double, solved boolean")

    def nuisances(self) -> DataFrame:
        """(regimen, cause, horizon, time, followers, epsilon, loss, targeted_loss): weighted squared error of every regression, on the unit scale."""
        rows = [(c.label, self.frame.design.causes[c.cause], c.horizon, t, v[0], c.epsilon[t], v[3], v[4]) for c in self.cells for t, v in sorted(c.nodes.items())]
        return self.df.sparkSession.createDataFrame(rows, "regimen string, cause string, horizon int, time int, followers long, epsilon double, loss double, targeted_loss double")

    def curve(self, scale: str = "risk") -> DataFrame:
        """(regimen, cause, horizon, value, lower, upper); survival maps x to 1 - x and swaps the bounds."""
        rows = []
        for c, e in zip(self.cells, self.means, strict=True):
            low, high = e.interval()
            v = (e.psi, low, high) if scale == "risk" else (1 - e.psi, 1 - high, 1 - low)
            rows.append((c.label, self.frame.design.causes[c.cause], c.horizon, *v))
        return self.df.sparkSession.createDataFrame(rows, "regimen string, cause string, horizon int, value double, lower double, upper double")

    def incidence_total(self) -> DataFrame:
        """Sum of the causes' incidences by regimen and horizon, its standard error and its excess over one."""
        rows = []
        for key in dict.fromkeys((c.label, c.horizon) for c in self.cells):
            at = [i for i, c in enumerate(self.cells) if (c.label, c.horizon) == key]
            total = sum(self.means[i].psi for i in at)
            rows.append((*key, total, math.sqrt(max(self.cov[np.ix_(at, at)].sum(), 0.0)), max(total - 1, 0.0)))
        return self.df.sparkSession.createDataFrame(rows, "regimen string, horizon int, total double, std_err double, excess double")

    def stagewise(self) -> DataFrame:
        """Per regimen and time: rows at risk and following, largest weight, effective size, truncated share."""
        done = None
        for p in self.plans:
            for t in range(1, self.frame.design.times + 1):
                follow = following(self.frame, p.label, t)
                v = F.when(follow, F.col("w") / F.col(f"cum_{p.label}_{t}")).otherwise(lit(0))
                part = self.df.select(indicator(at_risk(self.frame, p.label, t)).alias("r"), indicator(follow).alias("f"), v.alias("v"), F.abs(F.col(f"cum_{p.label}_{t}") - F.col(f"raw_{p.label}_{t}")).alias("x"))
                part = part.agg(F.sum("r").cast("long").alias("at_risk"), F.sum("f").cast("long").alias("following"), F.max("v").alias("max_weight"), (F.sum("v") ** 2 / F.sum(F.col("v") ** 2)).alias("effective_n"), (F.sum(F.col("f") * indicator(F.col("x") > 1e-12)) / F.sum("f")).alias("truncated"))
                part = part.select(F.lit(p.label).alias("regimen"), F.lit(t).alias("time"), "*")
                done = part if done is None else done.unionByName(part)
        return done


def mechanism_table(f: LongitudinalFrame, plans: Sequence[Regimen], s: Settings) -> DataFrame:
    """The frame with plans, folds if there are any, and the cumulative mechanisms."""
    df = with_plans(f, plans)
    if s.folds:
        df = with_folds(df, s.folds, seed=s.seed, cluster="cluster" if f.design.cluster else None)
    return fit_mechanism(f, df, plans, s)


def ltmle(f: LongitudinalFrame, regimens: Mapping[str, Sequence] | Sequence[Regimen], *, horizons: Sequence[int] | None = None, settings: Settings | None = None, reference: str | None = None) -> LongitudinalResult:
    """Means, risks or cumulative incidences under every regimen, and contrasts with the reference."""
    s = settings or Settings()
    plans = resolve_regimens(regimens, f.design.times)
    ref = reference or plans[0].label
    if ref not in {p.label for p in plans}:
        raise StudyError(f"no regimen {ref!r}")
    horizons = list(horizons or [f.design.times])
    if f.design.kind == "mean" and horizons != [f.design.times]:
        raise CapabilityError("a mean at the end has one horizon")
    base = mechanism_table(f, plans, s)
    cells = [fit_cell(f, base, p, cause, k, s) for p in plans for cause in range(len(f.design.causes)) for k in horizons]
    df = base
    for i, c in enumerate(cells, 1):
        df = c.add(df)
        if i % 12 == 0 and i < len(cells):
            df = durable(df, "cells")
    df = durable(df, "curves")
    cluster = "cluster" if f.design.cluster else None
    names = [c.ic for c in cells]
    _, cov, n = covariance(df, names, cluster)
    stem = {"mean": "ey_regimen", "survival": "risk_regimen", "competing": "cif_regimen"}[f.design.kind]

    def name(c: Cell, versus: str = "") -> str:
        parts = [c.label + (f" vs {versus}" if versus else "")]
        if f.design.kind == "competing":
            parts.append(f.design.causes[c.cause])
        if f.design.kind != "mean":
            parts.append(f"t{c.horizon}")
        return f"{'ate_regimen' if versus else stem}[{', '.join(parts)}]"

    means = [Estimate(name(c), c.psi, math.sqrt(max(cov[i, i], 0)), "level", n, s.alpha, stem, c.label, axis="regimen") for i, c in enumerate(cells)]
    contrasts = []
    for i, c in enumerate(cells):
        if c.label != ref:
            j = next(k for k, x in enumerate(cells) if (x.label, x.cause, x.horizon) == (ref, c.cause, c.horizon))
            var = cov[i, i] + cov[j, j] - 2 * cov[i, j]
            contrasts.append(Estimate(name(c, ref), c.psi - cells[j].psi, math.sqrt(max(var, 0)), "difference", n, s.alpha, "ate_regimen", c.label, ref, axis="regimen"))
    return LongitudinalResult(f, df, cells, means, contrasts, cov, plans)


def regimen_msm(result: LongitudinalResult, terms: Mapping[str, Callable[[Cell], float]], *, weights: Callable[[Cell], float] | None = None) -> list[Estimate]:
    """A working model over the regimen, cause and horizon cells: least squares on the means, curves through the projection.

    With terms that depend on cells alone the targeted means already solve the model's equations.
    """
    x = np.array([[t(c) for t in terms.values()] for c in result.cells], float)
    h = np.diag([weights(c) if weights else 1.0 for c in result.cells])
    gram = x.T @ h @ x
    if np.linalg.cond(gram) > 1e10:
        raise StudyError("the working model's terms are collinear")
    lift = np.linalg.solve(gram, x.T @ h)
    beta = lift @ np.array([e.psi for e in result.means])
    cov = lift @ result.cov @ lift.T
    return [Estimate(f"msm[{t}]", float(beta[i]), math.sqrt(max(cov[i, i], 0)), "level", result.means[0].n, 0.05, "msm", t, axis="msm") for i, t in enumerate(terms)]


@dataclass(frozen=True)
class RegimenMSM:
    """A working model of regimen means: terms are functions of the plan to a column, which may read the baseline (l_0_*)."""

    terms: Mapping[str, Callable[[Regimen], Column]]
    link: str = "identity"
    weights: Callable[[Regimen], float] | None = None


@dataclass
class MSMFit:
    """Coefficients on the link's scale, their covariance, and the row table with one curve per coefficient."""

    estimates: list[Estimate]
    cov: np.ndarray
    rows: DataFrame
    means: np.ndarray
    rounds: int

    def coefficients(self, scale: str = "link") -> DataFrame:
        return coefficient_frame(self.rows.sparkSession, self.estimates, scale)


def _normal_matrix(df: DataFrame, grams: Sequence[Column], moments: Sequence[Column], p: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.array([v or 0.0 for v in df.agg(*(F.sum(c) for c in [*grams, *moments])).first()], float)
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = r[: len(grams)]
    return m + np.triu(m, 1).T, r[len(grams) :]


def targeted_regimen_msm(f: LongitudinalFrame, regimens: Mapping[str, Sequence] | Sequence[Regimen], model: RegimenMSM, *, cause: int = 0, horizon: int | None = None, settings: Settings | None = None, rounds: int = 8, tol: float = 1e-10) -> MSMFit:
    """A working model fitted by targeting: all regimens go back in lockstep, and at every time one fluctuation with an
    epsilon per term solves the model's equations pooled over them.

    The fluctuation's covariate is the term times the model's weight and the slope of the link, so under a link
    other than the identity targeting and projection alternate.
    """
    s = settings or Settings()
    plans = resolve_regimens(regimens, f.design.times)
    horizon = horizon or f.design.times
    names = list(model.terms)
    p, span = len(names), f.high - f.low
    mean, slope, curvature = _LINKS[model.link]
    base = mechanism_table(f, plans, s)
    phi = {c.label: [model.terms[t](c) for t in names] for c in plans}
    h = {c.label: lit(model.weights(c) if model.weights else 1.0) for c in plans}
    upper = list(zip(*np.triu_indices(p), strict=True))
    beta = np.zeros(p)
    if model.link != "identity":
        centre = sum(fit_cell(f, base, c, cause, horizon, s).psi for c in plans) / len(plans)
        beta[0] = math.log(centre) if model.link == "log" else math.log(centre / (1 - centre))
    eta = lambda label, b: reduce(lambda x, y: x + y, (lit(v) * x for v, x in zip(b, phi[label], strict=True)))

    def lockstep(b: np.ndarray) -> tuple[DataFrame, dict[str, list[Column]]]:
        """The table with s_{label}_1 for every plan, and the weighted residuals of each plan by time."""
        df = base
        carried = {c.label: _end(f) for c in plans}
        residuals: dict[str, list[Column]] = {c.label: [] for c in plans}
        for t in range(horizon, 0, -1):
            grams, moments = [lit(0)] * len(upper), [lit(0)] * p
            for c in plans:
                follow = following(f, c.label, t)
                z, q = f"z_{c.label}_{t}", f"q_{c.label}_{t}"
                df = df.withColumn(z, F.when(follow, _pseudo(f, t, cause, carried[c.label])))
                df = _regress(f, df, s, t, horizon, follow, z, q)(df)
                if s.fluctuation != "linear":
                    df = df.withColumn(q, shrink(F.col(q)))
            x = {c.label: [h[c.label] * slope(eta(c.label, b)) * v for v in phi[c.label]] for c in plans}
            eps = np.zeros(p)
            for _ in range(1 if s.fluctuation == "linear" else 30):
                grams, moments = [lit(0)] * len(upper), [lit(0)] * p
                for c in plans:
                    follow, q = following(f, c.label, t), F.col(f"q_{c.label}_{t}")
                    weight = F.when(follow, F.col("w") / F.col(f"cum_{c.label}_{t}")).otherwise(lit(0))
                    now = _moved(q, x[c.label], eps, s.fluctuation)
                    core = lit(1) if s.fluctuation == "linear" else now * (lit(1) - now)
                    gap = F.coalesce(F.col(f"z_{c.label}_{t}") - now, lit(0))
                    grams = [g + weight * core * x[c.label][i] * x[c.label][j] for g, (i, j) in zip(grams, upper, strict=True)]
                    moments = [m + weight * x[c.label][i] * gap for i, m in enumerate(moments)]
                gram, moment = _normal_matrix(df, grams, moments, p)
                move = solve(gram, moment)
                eps = eps + (move if s.fluctuation == "linear" else np.clip(move, -5, 5))
                if np.abs(move).max() < 1e-12:
                    break
            for c in plans:
                follow, risk = following(f, c.label, t), at_risk(f, c.label, t)
                name = f"s_{c.label}_{t}"
                df = df.withColumn(name, F.when(risk, _moved(F.col(f"q_{c.label}_{t}"), x[c.label], eps, s.fluctuation)))
                carried[c.label] = F.coalesce(F.col(name), lit(0.5))
                residuals[c.label].append(F.when(follow, (F.col(f"z_{c.label}_{t}") - F.col(name)) / F.col(f"cum_{c.label}_{t}")).otherwise(lit(0)))
            df = durable(df, f"lockstep-{t}")
        return df, residuals

    def project(df: DataFrame, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        matrix = np.zeros((p, p))
        for _ in range(50):
            grams, moments = [lit(0)] * len(upper), [lit(0)] * p
            for c in plans:
                e = eta(c.label, b)
                gap = lit(f.low) + lit(span) * F.col(f"s_{c.label}_1") - mean(e)
                core = F.col("w") * h[c.label] * (slope(e) ** 2 - gap * curvature(e))
                grams = [g + core * phi[c.label][i] * phi[c.label][j] for g, (i, j) in zip(grams, upper, strict=True)]
                moments = [m + F.col("w") * h[c.label] * slope(e) * gap * phi[c.label][i] for i, m in enumerate(moments)]
            matrix, moment = _normal_matrix(df, grams, moments, p)
            if np.linalg.cond(matrix) > 1e10:
                raise StudyError("the working model's terms are collinear")
            move = solve(matrix, moment)
            b = b + (move if model.link == "identity" else np.clip(move, -2, 2))
            if model.link == "identity" or np.abs(move).max() < 1e-12:
                break
        return b, matrix / f.n

    done = 0
    for done in range(1, (1 if model.link == "identity" else rounds) + 1):
        df, residuals = lockstep(beta)
        before = beta
        beta, matrix = project(df, beta)
        if np.abs(beta - before).max() < tol:
            break
    inner = []
    for i in range(p):
        parts = []
        for c in plans:
            e = eta(c.label, beta)
            whole = reduce(lambda a, b: a + b, residuals[c.label])
            parts.append(h[c.label] * slope(e) * phi[c.label][i] * (lit(span) * whole + lit(f.low) + lit(span) * F.col(f"s_{c.label}_1") - mean(e)))
        inner.append(F.col("w") * reduce(lambda a, b: a + b, parts))
    inverse = np.linalg.inv(matrix)
    curves = [reduce(lambda a, b: a + b, (lit(inverse[j, i]) * inner[i] for i in range(p))).alias(f"ic_{j}") for j in range(p)]
    rows = df.select("id", "cluster", *curves)
    means, cov, n = covariance(rows, [f"ic_{j}" for j in range(p)], "cluster" if f.design.cluster else None)
    found = [Estimate(f"msm[{t}]", float(beta[j]), math.sqrt(max(cov[j, j], 0)), "level", n, s.alpha, "msm", t, axis="msm") for j, t in enumerate(names)]
    return MSMFit(found, cov, rows, means, done)


def _moved(q: Column, x: Sequence[Column], eps: np.ndarray, kind: str) -> Column:
    shift = reduce(lambda a, b: a + b, (lit(e) * v for e, v in zip(eps, x, strict=True)))
    return q + shift if kind == "linear" else expit(safe_logit(q) + shift)
