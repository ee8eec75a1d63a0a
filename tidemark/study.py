"""The question layer: a study of a frame under a design, typed estimands, identified effects, methods.

    study = CausalStudy(df, PointDesign("y", "a", "id", ("w",)))
    result = study.identify(ATE()).estimate()

Everything up to ``estimate`` reads the schema and validation counts only; what is not available is refused
there by name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame

from .design import LongitudinalDesign, LongitudinalFrame, PointDesign, PointFrame, longitudinal_frame, point_frame
from .errors import CapabilityError, StudyError
from .operators import longitudinal as L
from .operators import point as P
from .operators.dose import Shift, shift_means
from .operators.inference import bands, normal_critical, select_estimates


@dataclass(frozen=True)
class Estimand:
    """A question; subclasses say which."""

    stem = ""


@dataclass(frozen=True)
class ATE(Estimand):
    stem = "ate"


@dataclass(frozen=True)
class ATT(Estimand):
    stem = "att"


@dataclass(frozen=True)
class ATC(Estimand):
    stem = "atc"


@dataclass(frozen=True)
class CounterfactualMean(Estimand):
    stem = "ey"


@dataclass(frozen=True)
class NaturalCourse(Estimand):
    stem = "ey_obs"


@dataclass(frozen=True)
class PopulationAttributableRisk(Estimand):
    stem = "par"


@dataclass(frozen=True)
class PopulationAttributableFraction(Estimand):
    stem = "paf"


@dataclass(frozen=True)
class RiskRatio(Estimand):
    stem = "rr"


@dataclass(frozen=True)
class OddsRatio(Estimand):
    stem = "or"


@dataclass(frozen=True)
class ControlledDirectEffect(Estimand):
    """A contrast with the binary intermediate fixed."""

    value: int = 0
    contrast: str = "ate"
    stem = "cde"


@dataclass(frozen=True)
class ConditionalEffect(Estimand):
    """The contrast within the design's strata."""

    stem = "cate"


@dataclass(frozen=True)
class RegimeMeans(Estimand):
    """Known regimes: a density over the arms each, as columns."""

    regimes: Mapping[str, Sequence[Column]] = field(default_factory=dict)
    stem = "ey_regime"


@dataclass(frozen=True)
class OddsTilt(Estimand):
    delta: float = 1.0
    stem = "ey_ipsi"


@dataclass(frozen=True)
class DoseShift(Estimand):
    shifts: Mapping[str, Shift] = field(default_factory=dict)
    stem = "ey_shift"


@dataclass(frozen=True)
class WorkingModel(Estimand):
    model: P.MSM | None = None
    stem = "msm"


@dataclass(frozen=True)
class RegimenMeans(Estimand):
    """Longitudinal plans; the first is the reference of the contrasts."""

    regimens: Mapping[str, Sequence] | Sequence[L.Regimen] = ()
    horizons: tuple[int, ...] = ()
    stem = "regimen"


@dataclass(frozen=True)
class Method:
    """How to estimate.  ``tmle`` is always available; ``collaborative`` and ``drtmle`` for arm-axis effects."""

    name: str = "tmle"
    config: P.Config = P.Config()
    options: Mapping[str, Any] = field(default_factory=dict)

    def with_overrides(self, **changes: Any) -> Method:
        known = {k: v for k, v in changes.items() if k in P.Config.__dataclass_fields__}
        return Method(self.name, replace(self.config, **known), {**self.options, **{k: v for k, v in changes.items() if k not in known}})


def TMLEMethod(**config: Any) -> Method:  # noqa: N802  (a method, spelt like a type)
    """Plain targeting; keywords are those of the configuration, and no others."""
    unknown = set(config) - set(P.Config.__dataclass_fields__)
    if unknown:
        raise StudyError(f"unknown settings {sorted(unknown)}")
    return Method("tmle", P.Config(**config))


def CollaborativeMethod(config: P.Config = P.Config(), *, strategy: str = "greedy", order: Sequence[str] | str = "logistic", selection_folds: int = 3, loss: str = "squared") -> Method:  # noqa: N802
    """Covariates of the treatment model chosen by the targeted outcome loss."""
    if strategy not in ("greedy", "ordered", "outcome_adaptive") or loss not in ("squared", "likelihood") or selection_folds < 2:
        raise StudyError("a strategy, a loss and two selection folds or more are needed")
    return Method("collaborative", config, {"strategy": strategy, "order": order, "selection_folds": selection_folds, "loss": loss})


def GuardedMethod(config: P.Config = P.Config(), *, guard: Sequence[str] = ("q", "g"), rounds: int = 15, tol: float = 1e-6, learner: Any = None) -> Method:  # noqa: N802
    """Inference that holds if either nuisance is consistent."""
    if not guard or not set(guard) <= {"q", "g"} or rounds < 1 or tol <= 0:
        raise StudyError("guards are q and g, with a positive number of rounds and tolerance")
    return Method("drtmle", config, {"guard": tuple(guard), "rounds": rounds, "tol": tol, "learner": learner})


_ARM = (ATE, ATT, ATC, CounterfactualMean, NaturalCourse, PopulationAttributableRisk, PopulationAttributableFraction, RiskRatio, OddsRatio)
_SELECTIVE = (ATE, CounterfactualMean, RiskRatio, OddsRatio)


@dataclass(frozen=True)
class IdentifiedEffect:
    study: CausalStudy
    estimand: Estimand
    assumptions: tuple[str, ...]

    def available_methods(self) -> dict[str, str]:
        """Method -> why not, or an empty text."""
        selective = isinstance(self.estimand, _SELECTIVE)
        return {"tmle": "", "collaborative": "" if selective else "for arm means and their contrasts only", "drtmle": "" if selective else "for arm means and their contrasts only", "riesz": "not built", "entropy_balancing": "not built"}

    def estimate(self, method: str | Method = "tmle", **overrides: Any) -> Any:
        m = Method(method) if isinstance(method, str) else method
        m = m.with_overrides(**overrides)
        why = self.available_methods().get(m.name, "unknown")
        if why:
            raise CapabilityError(f"{m.name}: {why}")
        return _run(self, m)


def _run(effect: IdentifiedEffect, m: Method) -> Any:
    e, f, c = effect.estimand, effect.study.frame, m.config
    if isinstance(e, RegimenMeans):
        return L.ltmle(f, e.regimens, horizons=e.horizons or None, settings=m.options.get("settings"))
    if m.name == "collaborative":
        from .operators.selective import collaborative

        return collaborative(f, (e.stem,), c, **m.options)
    if m.name == "drtmle":
        from .operators.guarded import doubly_robust

        return doubly_robust(f, c, **m.options)
    if isinstance(e, _ARM):
        return P.point_tmle(f, (e.stem,), c)
    if isinstance(e, ControlledDirectEffect):
        return P.point_tmle(f, (e.contrast,), c, z=e.value)
    if isinstance(e, ConditionalEffect):
        return P.strata_params(P.fit_nuisances(f, c))
    if isinstance(e, RegimeMeans):
        return P.regime_means(f, e.regimes, c)
    if isinstance(e, OddsTilt):
        return P.tilt_means(f, e.delta, c)
    if isinstance(e, DoseShift):
        return shift_means(f, e.shifts, c, **m.options)
    return P.msm_fit(f, e.model, c)


class CausalStudy:
    """A validated frame and its design."""

    def __init__(self, df: DataFrame, design: PointDesign | LongitudinalDesign):
        self.design = design
        self.frame: PointFrame | LongitudinalFrame = point_frame(df, design) if isinstance(design, PointDesign) else longitudinal_frame(df, design)

    def identify(self, estimand: Estimand) -> IdentifiedEffect:
        if not isinstance(estimand, Estimand):
            raise StudyError("an estimand is an object such as ATE(), not a name")
        self._check(estimand)
        seen = ["no unmeasured confounding given the covariates", "positivity", "consistency"]
        if isinstance(self.frame, PointFrame) and self.frame.has_delta:
            seen.append("outcomes missing at random given treatment and covariates")
        if isinstance(self.frame, LongitudinalFrame):
            seen.append("sequential exchangeability of treatment and censoring")
        return IdentifiedEffect(self, estimand, tuple(seen))

    def _check(self, e: Estimand) -> None:
        f = self.frame
        if isinstance(f, LongitudinalFrame) != isinstance(e, RegimenMeans):
            raise CapabilityError("regimen means need a longitudinal design, and only they do")
        if isinstance(f, LongitudinalFrame):
            L.resolve_regimens(e.regimens, f.design.times)
            return
        if f.dose != isinstance(e, DoseShift):
            raise CapabilityError("dose shifts need a continuous treatment, and only they do")
        if isinstance(e, _ARM):
            P.resolve_estimands(f, (e.stem,))
        if isinstance(e, ControlledDirectEffect) and not f.has_intermediate:
            raise StudyError("no intermediate is declared")
        if isinstance(e, ConditionalEffect) and not f.has_strata:
            raise StudyError("no strata are declared")
        if isinstance(e, OddsTilt) and f.arms != 2:
            raise CapabilityError("odds tilts need a binary treatment")
        if isinstance(e, WorkingModel) and e.model is None:
            raise StudyError("a working model has terms")


def simultaneous(result: P.Result, alpha: float = 0.05, names: Sequence[str] | None = None) -> list[tuple[str, float, float]]:
    """Bands that hold for all of a result's parameters together, or for the named ones, which makes them narrower."""
    at = list(range(len(result.estimates))) if names is None else [result.estimates.index(e) for e in select_estimates(result.estimates, names)]
    return bands([result.estimates[i] for i in at], normal_critical(result.cov[np.ix_(at, at)], alpha=alpha))
