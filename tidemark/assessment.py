"""The battery: what a result can be asked about itself, in one call each.

``validate`` reads only what a fit left behind; ``run_all`` adds what costs another targeting, and refits if they
are asked for.  A check that does not apply is recorded as skipped, with the reason.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import CapabilityError, StudyError
from .operators import covariate as C
from .operators import diagnostics as D
from .operators import sensitivity as V
from .operators.longitudinal import LongitudinalResult
from .operators.point import Result, retarget

ROW = "check string, status string, detail string"


def replayability(result: Any) -> dict[str, bool]:
    """What can still be run again from this result: its score checks, another targeting, a refit."""
    if isinstance(result, LongitudinalResult):
        return {"scores": True, "retarget": False, "refit": result.frame is not None}
    held = result.nuisances is not None
    return {"scores": bool(result.targeted), "retarget": held, "refit": held and result.frame is not None}


def support(result: Any) -> DataFrame:
    """The overlap report that fits the result: by regimen and time, by regime, by tilt, or by arm."""
    if isinstance(result, LongitudinalResult):
        return result.stagewise()
    if result.nuisances is None:
        raise CapabilityError("the result has no nuisances to look at")
    n = result.nuisances
    for t in result.targeted.values():
        if t.group == "regime":
            return C.check_support(n.df, t.setting.regimes, n.frame.arms)
    tilts = {k: d for t in result.targeted.values() if t.group == "ipsi" for k, d in t.setting.tilts.items()}
    if tilts:
        return C.tilt_support(n.df, tilts)
    if n.frame.dose:
        raise CapabilityError("shifts report their support from the density: shift_support")
    return D.positivity(n)


def _cheap(result: Any) -> dict[str, Callable[[], tuple[bool, str]]]:
    """Checks that need no pass over the data, or one aggregate."""
    if isinstance(result, LongitudinalResult):
        estimates, cov = result.means + result.contrasts, result.cov
    else:
        estimates, cov = result.estimates, result.cov

    def finite() -> tuple[bool, str]:
        bad = [e.name for e in estimates if not np.isfinite([e.psi, e.std_err]).all() or e.std_err < 0]
        return not bad, ", ".join(bad)

    def covariance() -> tuple[bool, str]:
        least = float(np.linalg.eigvalsh(cov).min()) if len(cov) else 0.0
        return least >= -1e-9 * max(float(np.abs(cov).max(initial=0)), 1e-300) and bool(np.allclose(cov, cov.T)), f"least eigenvalue {least:.3g}"

    def ranges() -> tuple[bool, str]:
        frame = result.frame
        low, high = frame.low, frame.high
        out = [e.name for e in estimates if e.scale == "level" and e.estimand != "msm" and not low - 1e-9 <= e.psi <= high + 1e-9]
        return not out, ", ".join(out)

    def scores() -> tuple[bool, str]:
        if isinstance(result, LongitudinalResult):
            left = [f"{c.label} t{t}" for c in result.cells for t, v in c.nodes.items() if abs(v[1]) > 1e-3 * v[2] + 1e-12]
        else:
            left = [e.name for e, ok in zip(result.estimates, result.solved(), strict=True) if not ok]
        return not left, ", ".join(left)

    def converged() -> tuple[bool, str]:
        if isinstance(result, LongitudinalResult):
            return True, ""
        left = [f"{k}: {t.fluctuation.reason}" for k, t in result.targeted.items() if not t.fluctuation.converged]
        return not left, ", ".join(left)

    return {"finite": finite, "covariance": covariance, "ranges": ranges, "scores": scores, "converged": converged}


def _recorded(spark, checks: dict[str, Callable[[], tuple[bool, str]]]) -> DataFrame:
    rows = []
    for name, check in checks.items():
        try:
            passed, detail = check()
            rows.append((name, "passed" if passed else "failed", detail))
        except (CapabilityError, StudyError) as why:
            rows.append((name, "skipped", str(why)))
    return spark.createDataFrame(rows, ROW)


def _spark(result: Any):
    return (result.df if isinstance(result, LongitudinalResult) else result.rows).sparkSession


def validate(result: Any) -> DataFrame:
    """(check, status, detail) of the checks that read only what the fit left."""
    return _recorded(_spark(result), _cheap(result))


def run_all(result: Any, *, include_retargets: bool = False, include_refits: bool = False) -> DataFrame:
    """(check, status, detail) of every check; retargets and refits only where they are asked for."""
    checks = _cheap(result)
    if isinstance(result, LongitudinalResult):
        checks["support"] = lambda: (bool(result.stagewise().agg(F.max("truncated")).first()[0] < 0.1), "share of truncated followers below a tenth")
        return _recorded(_spark(result), checks)
    n = result.nuisances

    def needs(what: bool, why: str) -> None:
        if not what:
            raise CapabilityError(why)

    def positivity() -> tuple[bool, str]:
        needs(n is not None and not n.frame.dose, "arms only")
        worst = D.positivity(n).agg(F.max("below_01"), F.max("truncated")).first()
        return worst[0] < 0.1, f"share below 0.01: {worst[0]:.4g}, truncated: {worst[1]:.4g}"

    def mechanisms() -> tuple[bool, str]:
        needs(n is not None and (n.frame.has_delta or n.z is not None), "no mechanism but the treatment's")
        worst = D.mechanism_overlap(n).agg(F.max("below_05")).first()[0]
        return worst < 0.1, f"share below 0.05: {worst:.4g}"

    def simplex() -> tuple[bool, str]:
        needs(n is not None and n.frame.arms > 2, "more than two arms only")
        off = D.simplex_deviation(n)
        return off < 0.1, f"largest deviation {off:.4g}"

    def calibration() -> tuple[bool, str]:
        needs(n is not None and not n.frame.dose, "arms only")
        slopes = {r["model"]: r["value"] for r in D.nuisance_report(n).where("metric = 'slope'").collect()}
        return all(not np.isfinite(v) or 0.5 <= v <= 2 for v in slopes.values()), ", ".join(f"{k} {v:.3g}" for k, v in sorted(slopes.items()))

    def truncation() -> tuple[bool, str]:
        needs(include_retargets, "another targeting was not asked for")
        needs(n is not None and any(e.name == "ate" for e in result.estimates), "the contrast of two arms only")
        base, again = result["ate"], retarget(n, ("ate",), g_low=0.05)["ate"]
        return abs(again.psi - base.psi) <= 2 * base.std_err, f"{base.psi:.6g} at its own bound, {again.psi:.6g} at 0.05"

    def robustness() -> tuple[bool, str]:
        needs("mean" in result.targeted and n.frame.arms == 2, "the contrast of two arms only")
        value = V.robustness_value(V.elements(n, result.targeted["mean"]))
        return value > 0.01, f"robustness value {value:.4g}"

    def placebo() -> tuple[bool, str]:
        needs(include_refits, "refits were not asked for")
        needs(n is not None and n.frame.arms == 2, "two arms only")
        from .operators.resample import refute

        r = refute(n.frame, n.config, tests=("placebo",), replicates=1).first()
        return r["passed"], f"placebo effect {r['refuted']:.6g}"

    checks |= {"positivity": positivity, "mechanisms": mechanisms, "simplex": simplex, "calibration": calibration, "truncation": truncation, "robustness": robustness, "placebo": placebo}
    return _recorded(_spark(result), checks)
