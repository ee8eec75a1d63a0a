"""Point-treatment engine: nuisances -> covariates -> targeting -> influence curves -> estimates.

Everything between two jobs is one lazy frame of wide columns, so Catalyst prunes and fuses it; what comes to
the driver are sums.
"""

from __future__ import annotations

import math
import weakref
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..design import PointFrame
from ..errors import CapabilityError, StudyError
from ..functions.expr import by_code, indicator, lit, shrink, total
from ..sources.store import durable
from . import covariate as C
from .folds import refuse_scheme, with_folds
from .inference import Estimate, coefficient_frame, covariance, cross_validated_variance, select_estimates
from .learn import FOLD, CellMean, Task, resolve_learner, solve
from .target import MECHANISMS, Fluctuation, apply, register_mechanism, solve_fluctuation, solve_mechanism, solve_one_step, tilted


@dataclass(frozen=True)
class Config:
    """How to estimate; what to estimate is in the question."""

    outcome_learner: Any = None
    treatment_learner: Any = None
    missingness_learner: Any = None
    intermediate_learner: Any = None
    outcome_cells: tuple[str, ...] | None = None
    folds: int = 0
    scheme: str = "stratified"
    stratify: bool = True
    seed: int = 0
    fluctuation: str = "logistic"
    algorithm: str = "newton"
    target_weights: bool = False
    fold_targeting: bool = False
    fold_evaluation: bool = False
    g_low: float | None = None
    conditional_low: float = 0.025
    nuisance_low: float = 0.01
    alpha: float = 0.05
    reference: int = 0
    max_iter: int = 50
    tol: float = 1e-10


def released(df: DataFrame) -> DataFrame:
    """A persisted frame whose cache goes when nothing refers to the frame any more."""
    weakref.finalize(df, _drop, df._jdf)
    return df


def _drop(jdf: Any) -> None:
    try:
        jdf.unpersist(False)
    except Exception:  # noqa: BLE001  (the session may be gone by then)
        pass


@dataclass
class Nuisances:
    """The nuisance table: canonical columns, ys, fold, g_k, pi_k, qz_k, q_k and q_obs."""

    frame: PointFrame
    df: DataFrame
    config: Config
    z: int | None = None
    fractions: tuple[float, ...] = ()

    @property
    def folds(self) -> int:
        return self.config.folds


def _features(f: PointFrame, arm: Column | None, z: Column | None = None) -> list[Column]:
    block = [] if arm is None else [indicator(arm == k) for k in range(1, f.arms)]
    return block + ([] if z is None else [z]) + [F.col(c) for c in f.x]


def _at_arms(model: Any, df: DataFrame, f: PointFrame, stem: str, others: Sequence[Column], z: Column | None = None) -> DataFrame:
    """Predictions at every arm: {stem}_k."""
    if hasattr(model, "predict_arms"):
        return model.predict_arms(df, [f"{stem}_{k}" for k in range(f.arms)], others)
    for k in range(f.arms):
        df = model.predict(df, f"{stem}_{k}", _features(f, F.lit(k), z), [F.lit(k), *others])
    return df


def fit_nuisances(f: PointFrame, config: Config, z: int | None = None) -> Nuisances:
    """g for every arm, the observation and intermediate mechanisms, and the outcome regression at every arm."""
    if f.dose:
        raise CapabilityError("a dose needs shift_means")
    if z is not None and not f.has_intermediate:
        raise StudyError("no intermediate is declared")
    refuse_scheme(config.scheme)
    df = f.df.withColumn("ys", f.scaled())
    if config.folds:
        deal = config.stratify and config.scheme == "stratified"
        if deal and f.arm_counts and min(f.arm_counts) < config.folds:  # no more folds than the rarest arm has rows
            config = replace(config, folds=min(f.arm_counts))
        # Strata are the arms, and for a binary outcome the arms by outcome, so that no fold lacks either.
        deck = F.col("a") * 3 + (F.coalesce(F.col("y").cast("int"), F.lit(2)) if f.family == "binomial" else F.lit(0))
        df = with_folds(df.withColumn("deck__", deck), config.folds, seed=config.seed, stratify="deck__" if deal else None, cluster="cluster" if f.has_cluster else None).drop("deck__")
    learner = resolve_learner
    w, cells = F.col("w"), [F.col(c) for c in f.cells]
    arms = range(f.arms)
    base = _features(f, None)
    names = [f"g_{k}" for k in arms]
    g = learner(config.treatment_learner, True)
    one_pass = isinstance(g, CellMean) and not config.folds
    if one_pass:
        df = g.shares(df, F.col("a"), f.arms, w, cells, names)
    for k in () if one_pass else arms if f.arms > 2 else (1,):
        df = g.fit(df, Task(indicator(F.col("a") == k), w, None, config.folds, True), base, cells).predict(df, f"g_{k}", base, cells)
    if f.arms == 2:
        df = df.withColumn("g_0", lit(1) - F.col("g_1"))
    elif not one_pass:
        df = df.withColumn("g__sum", total(F.col(c) for c in names)).withColumns({c: F.col(c) / F.col("g__sum") for c in names}).drop("g__sum")
    if f.has_delta:
        m = learner(config.missingness_learner, True).fit(df, Task(F.col("delta"), w, None, config.folds, True), _features(f, F.col("a")), [F.col("a"), *cells])
        df = _at_arms(m, df, f, "pi", cells)
    if z is not None:
        m = learner(config.intermediate_learner, True).fit(df, Task(F.col("z"), w, None, config.folds, True), _features(f, F.col("a")), [F.col("a"), *cells])
        df = _at_arms(m, df, f, "qz", cells)
    inner = cells if config.outcome_cells is None else [F.col(c) for c in config.outcome_cells]
    seen = None if not f.has_delta else F.col("delta") == 1
    zc, zf = (None, None) if z is None else (F.col("z"), lit(z))
    q = learner(config.outcome_learner, f.family == "binomial").fit(df, Task(F.col("ys"), w, seen, config.folds, f.family == "binomial"), _features(f, F.col("a"), zc), [F.col("a"), *([] if z is None else [F.col("z")]), *inner])
    df = _at_arms(q, df, f, "q", [*([] if z is None else [zf]), *inner], zf)
    if z is None:
        df = df.withColumn("q_obs", by_code(F.col("a"), [F.col(f"q_{k}") for k in arms]))
    else:
        df = q.predict(df, "q_obs", _features(f, F.col("a"), zc), [F.col("a"), F.col("z"), *inner])
    if config.fluctuation == "logistic":
        df = df.withColumns({c: shrink(F.col(c)) for c in ["q_obs", *(f"q_{k}" for k in arms)]})
    df = released(df.persist())
    shares = {r["a"]: r["s"] for r in df.groupBy("a").agg((F.sum("w") / lit(f.n)).alias("s")).collect()}
    return Nuisances(f, df, config, z, tuple(shares.get(k, 0.0) for k in arms))


def setting(n: Nuisances, **more: Any) -> C.Setting:
    f, c = n.frame, n.config
    low = c.g_low if c.g_low is not None else C.auto_bound(f.effective_n or f.n)
    return C.Setting(f.arms, low, c.conditional_low, c.nuisance_low, f.has_delta, n.z, c.reference, n.fractions, tuple(str(v) for v in f.levels), **more)


@dataclass
class Targeted:
    """One group after targeting: the table has qs_obs, qs_k."""

    group: str
    df: DataFrame
    components: Sequence[C.Component]
    fluctuation: Fluctuation
    setting: C.Setting
    epsilon_g: float = 0.0
    again: Callable[[DataFrame], DataFrame] | None = None
    """Adds qs_obs and qs_k to any frame with the nuisance columns, so that several groups share one frame."""


def target(n: Nuisances, group: str, **more: Any) -> Targeted:
    """Solve one group's score equations; tilts alternate between the outcome and the mechanism."""
    c = n.config
    s = setting(n, **more)
    if group == "ipsi":
        if c.fold_targeting:
            raise CapabilityError("tilts are targeted on all rows together")
        return _target_tilt(n, s)
    if group not in C.GROUPS:
        raise StudyError(f"no group {group!r}")
    if group in ("att", "atc") and n.z is not None:
        raise CapabilityError("conditional effects are not defined with a fixed intermediate")
    return _solve(n, n.df, C.GROUPS[group](s), s, group)


def _solve(n: Nuisances, df: DataFrame, components: Sequence[C.Component], s: C.Setting, group: str) -> Targeted:
    c = n.config
    use, extra = (components, None) if not c.target_weights else C.weighted_form(components)
    if extra is not None:
        # Where several components can be non-zero in one row, no single loss weight has all their scores.
        if len(extra) > 1 and group != "mean":
            raise CapabilityError(f"the covariate of {group} cannot move into the loss weight: its components overlap")
        extra = F.greatest(*extra) if len(extra) > 1 else extra[0]
    if c.algorithm == "one_step":
        fl = solve_one_step(df, use)
    else:
        fl = solve_fluctuation(df, use, kind=c.fluctuation, target_weight=extra, folds=c.folds if c.fold_targeting else 0, max_iter=c.max_iter, tol=c.tol)
    again = lambda d: apply(d, use, fl, range(n.frame.arms), c.fluctuation)
    return Targeted(group, again(df), components, fl, s, again=again)


def _tilt_mechanism(delta: float) -> Column:
    """How the tilted mean moves with g: the covariate of the mechanism's score."""
    *_, slope = C.tilt_parts(delta, F.col("g_1"))
    return slope * (F.col("qs_1") - F.col("qs_0"))


register_mechanism("ipsi", _tilt_mechanism, replace=True)


def _target_tilt(n: Nuisances, s: C.Setting, rounds: int = 50) -> Targeted:
    """Both score equations of odds tilts: epsilon of the outcome, then of the mechanism, until neither moves."""
    if len(s.tilts) != 1:
        raise CapabilityError("one tilt is targeted at a time")
    (delta,) = s.tilts.values()
    needed = ["id", "cluster", "w", "a", "ys", "delta", "q_obs", *(c for c in n.df.columns if c.startswith(("q_", "g_", "pi_")) and c != "q_obs"), *([FOLD] if n.folds else [])]
    df = n.df.select(*needed)
    eps_total = 0.0
    for _ in range(rounds):
        done = _solve(n, df, C.GROUPS["ipsi"](s), s, "ipsi")
        h = MECHANISMS["ipsi"](delta)
        table = done.df
        eps = solve_mechanism(table, h, tol=1e-12)
        eps_total += abs(eps)
        moved = np.abs(done.fluctuation.epsilon).max() + abs(eps)
        g = tilted(F.col("g_1"), h, eps)
        df = table.withColumn("g__new", g).drop("g_1", "g_0").withColumnRenamed("g__new", "g_1").withColumn("g_0", lit(1) - F.col("g_1"))
        df = durable(df.drop("q_obs", "q_0", "q_1").withColumnsRenamed({"qs_obs": "q_obs", "qs_0": "q_0", "qs_1": "q_1"}), "tilt")
        if moved < 1e-9:
            break
    final = df.withColumns({"qs_obs": F.col("q_obs"), "qs_0": F.col("q_0"), "qs_1": F.col("q_1")})
    return Targeted("ipsi", final, C.GROUPS["ipsi"](s), done.fluctuation, s, eps_total)


@dataclass
class Param:
    """A parameter before its variance: value, curve column (of the logarithm for ratios), and what it is."""

    name: str
    psi: float
    ic: Column
    scale: str
    estimand: str = ""
    arm: str = ""
    reference: str = ""
    stratum: str = ""
    axis: str = "arm"


@dataclass
class Result:
    """Estimates, their joint covariance, and the row table with one curve per parameter."""

    frame: PointFrame
    estimates: list[Estimate]
    cov: np.ndarray
    rows: DataFrame
    curves: list[str]
    means: np.ndarray
    targeted: dict[str, Targeted] = field(default_factory=dict)
    nuisances: Nuisances | None = None

    def __getitem__(self, name: str) -> Estimate:
        return next(e for e in self.estimates if e.name == name)

    def to_frame(self) -> DataFrame:
        from .inference import frame_of

        return frame_of(self.rows.sparkSession, self.estimates)

    def coefficients(self, scale: str = "link") -> DataFrame:
        """(term, psi, std_err, ci_lower, ci_upper) of a working model; ``scale="ratio"`` exponentiates what is on a log or logit scale."""
        return coefficient_frame(self.rows.sparkSession, self.estimates, scale)

    def select(self, names: Sequence[str]) -> list[Estimate]:
        return select_estimates(self.estimates, names)

    def influence_frame(self) -> DataFrame:
        return self.rows.select("id", *(F.col(c).alias(e.name) for c, e in zip(self.curves, self.estimates, strict=True)))

    def solved(self, gate: float = 1e-3) -> list[bool]:
        """Is each mean curve negligible against its standard error?"""
        return [bool(abs(m) <= gate * e.std_err / math.sqrt(e.n) + 1e-12) for m, e in zip(self.means, self.estimates, strict=True)]


def residual(t: Targeted) -> Column:
    return F.when(F.col("delta") == 1, F.col("ys") - F.col("qs_obs")).otherwise(lit(0))


def label(stem: str, arm: str = "", versus: str = "") -> str:
    """``ate``, ``ey[high]`` or ``ate[high vs low]``."""
    return stem if not arm else f"{stem}[{arm} vs {versus}]" if versus else f"{stem}[{arm}]"


def _weighted_mean(df: DataFrame, values: Mapping[str, Column]) -> dict[str, float]:
    keys = list(values)
    r = df.agg(*(F.sum(F.col("w") * values[k]) for k in keys), F.sum("w")).first()
    return {k: r[i] / r[len(keys)] for i, k in enumerate(keys)}


ARM_TARGETS = ("ey", "ey1", "ey0", "ate", "rr", "or", "ey_obs", "par", "paf")
BINARY_ONLY = ("rr", "or", "paf")


def resolve_estimands(f: PointFrame, requested: Sequence[str], z: int | None = None) -> list[str]:
    """Refuse what the outcome, the arms or the design do not allow."""
    for name in requested:
        if name not in (*ARM_TARGETS, "att", "atc"):
            raise StudyError(f"unknown estimand {name!r}")
        if name in BINARY_ONLY and f.family != "binomial":
            raise CapabilityError(f"{name} needs a binary outcome")
        if name in ("ey1", "ey0") and f.arms != 2:
            raise CapabilityError(f"{name} needs two arms; ask for ey")
        if name in ("ey_obs", "par", "paf") and (f.has_delta or z is not None):
            raise CapabilityError(f"{name} is not available with missing outcomes or an intermediate")
    return list(requested)


def mean_parts(t: Targeted, arm: int) -> tuple[Column, Column]:
    """The two halves of an arm mean's curve before weighting: the weighted residual, and the plug-in."""
    return t.components[arm].observed * residual(t), F.col(f"qs_{arm}")


def arm_params(n: Nuisances, t: Targeted, requested: Sequence[str]) -> list[Param]:
    """Means, contrasts, ratios and attributable effects from one targeting of the arm means."""
    f, span, low = n.frame, n.frame.span, n.frame.low
    arms = range(f.arms)
    psi = _weighted_mean(t.df, {f"q{k}": F.col(f"qs_{k}") for k in arms} | {"y": F.col("ys")})
    d = {k: F.col("w") * (sum(mean_parts(t, k)) - lit(psi[f"q{k}"])) for k in arms}
    d_y = F.col("w") * (F.col("ys") - lit(psi["y"]))
    names, ref = [str(v) for v in f.levels], n.config.reference
    others = [k for k in arms if k != ref]
    level = lambda x: low + span * x
    pair = lambda stem, k: label(stem) if f.arms == 2 else label(stem, names[k], names[ref])
    out: list[Param] = []
    for e in requested:
        if e == "ey":
            out += [Param(label(e, names[k]), level(psi[f"q{k}"]), lit(span) * d[k], "level", e, names[k]) for k in arms]
        elif e in ("ey1", "ey0"):
            k = int(e[2])
            out.append(Param(e, level(psi[f"q{k}"]), lit(span) * d[k], "level", e, names[k]))
        elif e == "ate":
            out += [Param(pair(e, k), span * (psi[f"q{k}"] - psi[f"q{ref}"]), lit(span) * (d[k] - d[ref]), "difference", e, names[k], names[ref]) for k in others]
        elif e == "ey_obs":
            out.append(Param(e, level(psi["y"]), lit(span) * d_y, "level", e))
        elif e == "par":
            out.append(Param(e, span * (psi["y"] - psi[f"q{ref}"]), lit(span) * (d_y - d[ref]), "difference", e, "", names[ref]))
        elif e == "paf":
            y, q = psi["y"], psi[f"q{ref}"]
            out.append(Param(e, 1 - q / y, -d[ref] / lit(y) + lit(q / y**2) * d_y, "fraction", e, "", names[ref]))
        elif e == "rr":
            out += [Param(pair(e, k), psi[f"q{k}"] / psi[f"q{ref}"], d[k] / lit(psi[f"q{k}"]) - d[ref] / lit(psi[f"q{ref}"]), "ratio", e, names[k], names[ref]) for k in others]
        elif e == "or":
            odds = lambda p: p / (1 - p)
            v = lambda p: lit(p * (1 - p))
            out += [Param(pair(e, k), odds(psi[f"q{k}"]) / odds(psi[f"q{ref}"]), d[k] / v(psi[f"q{k}"]) - d[ref] / v(psi[f"q{ref}"]), "ratio", e, names[k], names[ref]) for k in others]
    return out


def conditional_params(n: Nuisances, t: Targeted) -> list[Param]:
    """Effects among the treated or the controls: the contrast averaged over the conditioning arm."""
    f, ref = n.frame, n.config.reference
    names = [str(v) for v in f.levels]
    r = residual(t)
    out = []
    others = [k for k in range(f.arms) if k != ref]
    sums = t.df.agg(*(F.sum(F.when(F.col("a") == (k if t.group == "att" else ref), F.col("w") * (F.col(f"qs_{k}") - F.col(f"qs_{ref}")))) for k in others)).first()
    for k, comp, total_ in zip(others, t.components, sums, strict=True):
        arm = k if t.group == "att" else ref
        share = n.fractions[arm]
        psi = total_ / (share * f.n)
        ic = F.col("w") * (comp.observed * r + indicator(F.col("a") == arm) / lit(share) * (F.col(f"qs_{k}") - F.col(f"qs_{ref}") - lit(psi)))
        name = label(t.group) if f.arms == 2 else label(t.group, names[k], names[ref])
        out.append(Param(name, f.span * psi, lit(f.span) * ic, "difference", t.group, names[k], names[ref]))
    return out


def regime_params(n: Nuisances, t: Targeted, contrasts: bool = True) -> list[Param]:
    """Means under known regimes and their contrasts with the first."""
    f = n.frame
    mixes = {name: total(density[k] * F.col(f"qs_{k}") for k in range(f.arms)) for name, density in t.setting.regimes.items()}
    return _axis_params(n, t, mixes, "regime", contrasts)


def _axis_params(n: Nuisances, t: Targeted, mixes: Mapping[str, Column], axis: str, contrasts: bool, extra: Mapping[str, Column] | None = None) -> list[Param]:
    f = n.frame
    psi = _weighted_mean(t.df, mixes)
    r = residual(t)
    d = {}
    for comp, (name, mix) in zip(t.components, mixes.items(), strict=True):
        d[name] = F.col("w") * (comp.observed * r + mix - lit(psi[name]) + (extra[name] if extra else lit(0)))
    first = next(iter(mixes))
    out = [Param(label(f"ey_{axis}", m), f.low + f.span * psi[m], lit(f.span) * d[m], "level", f"ey_{axis}", m, axis=axis) for m in mixes]
    if contrasts:
        out += [Param(label(f"ate_{axis}", m, first), f.span * (psi[m] - psi[first]), lit(f.span) * (d[m] - d[first]), "difference", f"ate_{axis}", m, first, axis=axis) for m in list(mixes)[1:]]
    return out


def tilt_params(n: Nuisances, t: Targeted) -> list[Param]:
    """The mean under an odds tilt, with the mechanism's own term in the curve."""
    (name, delta), = t.setting.tilts.items()
    q0, q1, _, _, slope = C.tilt_parts(delta, F.col("g_1"))
    mixes = {name: q0 * F.col("qs_0") + q1 * F.col("qs_1")}
    extra = {name: slope * (F.col("qs_1") - F.col("qs_0")) * (F.col("a") - F.col("g_1"))}
    return _axis_params(n, t, mixes, "ipsi", False, extra)


def contrasts(result: Result, stem: str) -> Result:
    """``result`` with the difference of every level from the first, read off the joint curves and covariance."""
    first, *others = result.estimates
    found, lift = list(result.estimates), [np.eye(len(result.estimates))]
    rows, curves = result.rows, list(result.curves)
    for j, e in enumerate(others, 1):
        row = np.zeros(len(result.estimates))
        row[j], row[0] = 1.0, -1.0
        lift.append(row[None, :])
        se = math.sqrt(max(float(row @ result.cov @ row), 0.0))
        found.append(replace(e, name=label(stem, e.arm, first.arm), psi=e.psi - first.psi, std_err=se, scale="difference", estimand=stem, reference=first.arm))
        name = f"ic_{len(curves)}"
        rows, curves = rows.withColumn(name, F.col(result.curves[j]) - F.col(result.curves[0])), [*curves, name]
    whole = np.vstack(lift)
    return replace(result, estimates=found, cov=whole @ result.cov @ whole.T, means=whole @ result.means, rows=rows, curves=curves)


def estimate(n: Nuisances, groups: Mapping[str, tuple[Targeted, list[Param]]], *, alpha: float | None = None) -> Result:
    """Variances and covariances of all curves of one or more groups, joined on the id when they are several."""
    alpha = n.config.alpha if alpha is None else alpha
    curves, params = [], []
    keep = ["id", "cluster", *([FOLD] if n.folds else [])]
    shared = all(t.again is not None for t, _ in groups.values())
    rows = n.df if shared and len(groups) > 1 else None
    for t, ps in groups.values():
        names = [f"ic_{len(curves) + i}" for i in range(len(ps))]
        ics = [p.ic.alias(c) for p, c in zip(ps, names, strict=True)]
        if rows is not None and shared:  # one frame for all groups
            rows = t.again(rows).select(*n.df.columns, *curves, *ics)
        else:
            part = t.df.select(*keep, *ics)
            rows = part if rows is None else rows.join(part.drop(*keep[1:]), "id")
        curves += names
        params += ps
    rows = rows.select(*keep, *curves)
    cluster = "cluster" if n.frame.has_cluster else None
    means, cov, count = covariance(rows, curves, cluster)
    if n.config.fold_evaluation:
        variances = cross_validated_variance(rows, curves, cluster)
        cov = cov * np.sqrt(np.outer(variances / np.maximum(np.diag(cov), 1e-300), variances / np.maximum(np.diag(cov), 1e-300)))
    estimates = [Estimate(p.name, p.psi, math.sqrt(max(cov[i, i], 0.0)), p.scale, count, alpha, p.estimand, p.arm, p.reference, p.stratum, p.axis) for i, p in enumerate(params)]
    return Result(n.frame, estimates, cov, rows, curves, means, {k: t for k, (t, _) in groups.items()}, n)


def point_tmle(f: PointFrame, requested: Sequence[str] = ("ate",), config: Config = Config(), *, z: int | None = None, nuisances: Nuisances | None = None) -> Result:
    """Arm-axis estimands of one study."""
    requested = resolve_estimands(f, requested, z)
    n = nuisances or fit_nuisances(f, config, z)
    groups: dict[str, tuple[Targeted, list[Param]]] = {}
    arm = [e for e in requested if e in ARM_TARGETS]
    if arm:
        t = target(n, "mean")
        groups["mean"] = (t, arm_params(n, t, arm))
    for g in ("att", "atc"):
        if g in requested:
            t = target(n, g)
            groups[g] = (t, conditional_params(n, t))
    return estimate(n, groups)


def retarget(n: Nuisances, requested: Sequence[str], **changes: Any) -> Result:
    """Solve the targeting again on fitted nuisances, with other bounds or another algorithm."""
    return point_tmle(n.frame, requested, nuisances=Nuisances(n.frame, n.df, replace(n.config, **changes), n.z, n.fractions))


def regime_means(f: PointFrame, regimes: Mapping[str, Sequence[Column]], config: Config = Config(), *, nuisances: Nuisances | None = None) -> Result:
    """Means under static, dynamic or stochastic regimes: each a density over the arms, as columns."""
    n = nuisances or fit_nuisances(f, config)
    off = n.df.agg(*(F.max(F.abs(total(d) - lit(1))) for d in regimes.values())).first()
    if any(v > 1e-8 for v in off):
        raise StudyError("the densities of a regime must sum to one in every row")
    t = target(n, "regime", regimes=dict(regimes))
    return estimate(n, {"regime": (t, regime_params(n, t))})


def static(level: int, arms: int) -> list[Column]:
    return [lit(1.0 if k == level else 0.0) for k in range(arms)]


def rule(code: Column, arms: int) -> list[Column]:
    """A regime that assigns the arm with this code."""
    return [indicator(code == k) for k in range(arms)]


def tilt_means(f: PointFrame, delta: float | Sequence[float], config: Config = Config(), *, nuisances: Nuisances | None = None) -> Result:
    """Means when everyone's odds of treatment are multiplied by each delta, and contrasts with the first.

    Every tilt solves its own pair of score equations on the same nuisances.
    """
    deltas = [float(d) for d in ([delta] if isinstance(delta, (int, float)) else delta)]
    if not deltas or min(deltas) <= 0 or len(set(deltas)) != len(deltas):
        raise StudyError("odds are multiplied by different positive numbers")
    if config.g_low is not None:
        raise CapabilityError("a tilt does not truncate the mechanism")
    if config.target_weights:
        raise CapabilityError("a tilt is fluctuated by its covariate")
    n = nuisances or fit_nuisances(f, config)
    groups = {}
    for d in deltas:
        t = target(n, "ipsi", tilts={f"{d:g}": d})
        groups[f"{d:g}"] = (t, tilt_params(n, t))
    found = estimate(n, groups)
    return contrasts(found, "ate_ipsi") if len(deltas) > 1 else found


def strata_params(n: Nuisances, stem: str = "ate") -> Result:
    """An arm estimand within every stratum: one fluctuation with a block per stratum, curves scaled by n / n_s."""
    f = n.frame
    if not f.has_strata:
        raise StudyError("no strata are declared")
    if n.config.fold_evaluation:
        raise CapabilityError("strata are not evaluated fold by fold")
    shares = {r["s"]: r["v"] for r in n.df.groupBy("s").agg((F.sum("w") / lit(f.n)).alias("v")).orderBy("s").collect()}
    s = setting(n)
    base = C.GROUPS["mean"](s)
    comps = C.stratified(base, shares)
    t = _solve(n, n.df, comps, s, "mean")
    arms, ref, r = range(f.arms), n.config.reference, residual(t)
    sums = {row["s"]: row for row in t.df.groupBy("s").agg(*(F.sum(F.col("w") * F.col(f"qs_{k}")).alias(f"m{k}") for k in arms), F.sum("w").alias("sw")).collect()}
    out = []
    names = [str(v) for v in f.levels]
    for stratum, share in shares.items():
        psi = [sums[stratum][f"m{k}"] / sums[stratum]["sw"] for k in arms]
        inside = indicator(F.col("s") == stratum) / lit(share)
        d = [inside * F.col("w") * (base[k].observed * r + F.col(f"qs_{k}") - lit(psi[k])) for k in arms]
        for k in (k for k in arms if k != ref):
            out.append(Param(label(stem, names[k], names[ref]) + f"|{stratum}", f.span * (psi[k] - psi[ref]), lit(f.span) * (d[k] - d[ref]), "difference", stem, names[k], names[ref], stratum))
    return estimate(n, {"mean": (t, out)})


def fold_evaluated(n: Nuisances) -> DataFrame:
    """(fold, n, psi_k...): the targeted arm means of each fold, for the equal-weight average."""
    t = target(n, "mean")
    f = n.frame
    means = [(lit(f.low) + lit(f.span) * F.sum(F.col("w") * F.col(f"qs_{k}")) / F.sum("w")).alias(f"ey_{k}") for k in range(n.frame.arms)]
    return t.df.groupBy(FOLD).agg(F.count("*").alias("n"), *means)


def fold_evaluated_ate(n: Nuisances) -> Estimate:
    """The average over folds of the fold's own estimate, with the cross-validated variance."""
    f, ref = n.frame, n.config.reference
    if f.arms != 2:
        raise CapabilityError("fold evaluation is for two arms")
    t = target(n, "mean")
    k = 1 - ref
    per = t.df.groupBy(FOLD).agg(F.count("*").alias("n"), (F.sum(F.col("w") * (F.col(f"qs_{k}") - F.col(f"qs_{ref}"))) / F.sum("w")).alias("psi"), F.sum("w").alias("sw"), F.sum("w").alias("fw")).collect()
    psis = {r[FOLD]: r["psi"] for r in per}
    mean = sum(psis.values()) / len(psis)
    values = F.element_at(F.array(*(lit(psis[v]) for v in sorted(psis))), F.col(FOLD) + 1)
    ic = F.col("w") * ((t.components[k].observed - t.components[ref].observed) * residual(t) + F.col(f"qs_{k}") - F.col(f"qs_{ref}") - values)
    rows = t.df.select(FOLD, "cluster", (lit(f.span) * ic).alias("ic_0"))
    var = cross_validated_variance(rows, ["ic_0"], "cluster" if f.has_cluster else None)[0]
    return Estimate("ate", f.span * mean, math.sqrt(var), "difference", f.n, n.config.alpha, "ate")


def tmle(data: Any, *, spark: Any = None, outcome: str, treatment: str, id: str, covariates: Sequence[str] | None = None, estimands: Sequence[str] = ("ate",), config: Config = Config(), **roles: Any) -> Result:
    """From a table (a Spark frame, or with a session pandas, Arrow, columns or a path) and the names of its columns to estimates, in one call."""
    from ..design import PointDesign, point_frame
    from ..sources.store import as_frame

    return point_tmle(point_frame(as_frame(spark, data), PointDesign(outcome, treatment, id, tuple(covariates) if covariates is not None else None, **roles)), estimands, config)


@dataclass
class ResultSet:
    """Results of one question at each level of the intermediate."""

    results: Mapping[int, Result]

    def __getitem__(self, level: int) -> Result:
        return self.results[level]

    def to_frame(self) -> DataFrame:
        parts = [r.to_frame().select(F.lit(z).alias("intermediate"), "*") for z, r in self.results.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def by_intermediate(f: PointFrame, requested: Sequence[str] = ("ate",), config: Config = Config()) -> ResultSet:
    """The question with the intermediate fixed at 0, then at 1."""
    return ResultSet({z: point_tmle(f, requested, config, z=z) for z in (0, 1)})


# Marginal structural models.


@dataclass(frozen=True)
class MSM:
    """Terms of a working model: functions of the arm's code to a column, and optional weights by arm."""

    terms: Mapping[str, Callable[[int], Column]]
    weights: Callable[[int], Column] | None = None
    link: str = "identity"


def linear_msm(doses: Sequence[float], modifier: str | None = None) -> MSM:
    """1 and the arm's dose; with a modifier its main effect and the product too."""
    terms: dict[str, Callable[[int], Column]] = {"1": lambda k: lit(1), "a": lambda k: lit(doses[k])}
    if modifier:
        terms |= {modifier: lambda k: F.col(modifier), f"a:{modifier}": lambda k: lit(doses[k]) * F.col(modifier)}
    return MSM(terms)


_LINKS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column], Callable[[Column], Column]]] = {
    "identity": (lambda e: e, lambda e: lit(1), lambda e: lit(0)),
    "log": (lambda e: F.exp(e), lambda e: F.exp(e), lambda e: F.exp(e)),
    "logit": (
        lambda e: lit(1) / (lit(1) + F.exp(-e)),
        lambda e: F.exp(-e) / (lit(1) + F.exp(-e)) ** 2,
        lambda e: F.exp(-e) * (F.exp(-e) - lit(1)) / (lit(1) + F.exp(-e)) ** 3,
    ),
}


def register_link(name: str, mean: Callable, slope: Callable, curvature: Callable) -> None:
    _LINKS[name] = (mean, slope, curvature)


def project(df: DataFrame, model: MSM, arms: int, outcome: str = "qs", steps: int = 50, tol: float = 1e-12, low: float = 0.0, span: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(beta, M): the working model's best fit to the arm curves, by least squares or damped Newton steps."""
    mean, slope, curve = _LINKS[model.link]
    names = list(model.terms)
    p = len(names)
    beta = np.zeros(p)
    if model.link != "identity":
        centre = df.agg(F.avg(lit(low) + lit(span) * F.col(f"{outcome}_0"))).first()[0]
        beta[0] = math.log(max(centre, 1e-6)) if model.link == "log" else math.log(min(max(centre, 1e-6), 1 - 1e-6) / (1 - min(max(centre, 1e-6), 1 - 1e-6)))
    m = np.zeros((p, p))
    for _ in range(steps):
        grad, hess = [], []
        for k in range(arms):
            phi = [model.terms[t](k) for t in names]
            h = model.weights(k) if model.weights else lit(1)
            eta = total(lit(b) * x for b, x in zip(beta, phi, strict=True))
            gap = lit(low) + lit(span) * F.col(f"{outcome}_{k}") - mean(eta)
            grad.append([F.col("w") * h * slope(eta) * gap * x for x in phi])
            core = F.col("w") * h * (slope(eta) ** 2 - gap * curve(eta))
            hess.append([core * phi[i] * phi[j] for i in range(p) for j in range(i, p)])
        sums = [F.sum(total(g[i] for g in grad)) for i in range(p)] + [F.sum(total(x[i] for x in hess)) for i in range(len(hess[0]))]
        r = np.array(list(df.agg(*sums, F.sum("w")).first()), float)
        r = r[:-1] / r[-1]
        m = np.zeros((p, p))
        m[np.triu_indices(p)] = r[p:]
        m = m + np.triu(m, 1).T
        if np.linalg.cond(m) > 1e10:
            raise StudyError("the working model's terms are collinear")
        step = solve(m, r[:p])
        beta = beta + (step if model.link == "identity" else np.clip(step, -2, 2))
        if np.abs(step).max() < tol or model.link == "identity":
            break
    return beta, m


def msm_fit(f: PointFrame, model: MSM, config: Config = Config(), *, nuisances: Nuisances | None = None, rounds: int = 8) -> Result:
    """Coefficients of a marginal structural model on the original scale.

    Under the identity link one targeting solves the equations; with another link targeting and projection
    alternate, as the covariate depends on the coefficients.
    """
    n = nuisances or fit_nuisances(f, config)
    arms, names = range(f.arms), list(model.terms)
    mean, slope, _ = _LINKS[model.link]
    weight = {k: model.weights(k) if model.weights else lit(1) for k in arms}
    beta, m = project(n.df, model, f.arms, "q", low=f.low, span=f.span)
    df = n.df
    for _ in range(1 if model.link == "identity" else rounds):
        eta = {k: total(lit(b) * model.terms[t](k) for b, t in zip(beta, names, strict=True)) for k in arms}
        h = {k: weight[k] * slope(eta[k]) for k in arms}
        s = setting(n, basis=tuple(names), design={(t, k): model.terms[t](k) for t in names for k in arms}, model_weights=h)
        t = _solve(n, df, C.GROUPS["msm"](s), s, "msm")
        before = beta
        beta, m = project(t.df, model, f.arms, "qs", low=f.low, span=f.span)
        if np.abs(beta - before).max() < 1e-10:
            break
    eta = {k: total(lit(b) * model.terms[x](k) for b, x in zip(beta, names, strict=True)) for k in arms}
    r = residual(t)
    inner = []
    for j, x in enumerate(names):
        fitted = total(weight[k] * slope(eta[k]) * model.terms[x](k) * (lit(f.low) + lit(f.span) * F.col(f"qs_{k}") - mean(eta[k])) for k in arms)
        inner.append(F.col("w") * (lit(f.span) * t.components[j].observed * r + fitted))
    inverse = np.linalg.inv(m)
    params = [Param(label("msm", x), float(beta[j]), total(lit(inverse[j, i]) * inner[i] for i in range(len(names))), "level", "msm", x, axis="msm") for j, x in enumerate(names)]
    return estimate(n, {"msm": (t, params)})
