"""Clever covariates: for each fluctuation component its value at the observed row and at every arm.

All are column expressions over the nuisance table (g_k, pi_k, qz_k by arm code k); none is stored.  Groups are
looked up in ``GROUPS``, which takes registrations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CapabilityError, StudyError
from ..functions.expr import by_code, clip, indicator, lit
from .order import quantiles


@dataclass(frozen=True)
class Component:
    """One column of the submodel: ``observed`` multiplies epsilon in the observed regression, ``at[k]`` in arm k's."""

    name: str
    observed: Column
    at: Mapping[int, Column]


@dataclass(frozen=True)
class Setting:
    """What covariates are built from: arms, bounds, the fixed intermediate and the arm shares."""

    arms: int
    g_low: float
    conditional_low: float = 0.025
    nuisance_low: float = 0.01
    has_delta: bool = False
    z: int | None = None
    reference: int = 0
    fractions: tuple[float, ...] = ()
    names: tuple[str, ...] = ()
    regimes: Mapping[str, Sequence[Column]] = field(default_factory=dict)
    tilts: Mapping[str, float] = field(default_factory=dict)
    basis: tuple[str, ...] = ()
    design: Mapping[tuple[str, int], Column] = field(default_factory=dict)
    model_weights: Mapping[int, Column] = field(default_factory=dict)

    def g(self, k: int, low: float | None = None) -> Column:
        """Truncated mechanism: binary by complement, more arms one by one and not renormalised."""
        low = self.g_low if low is None else low
        if self.arms == 2:
            one = clip(F.col("g_1"), low, 1 - low)
            return one if k == 1 else lit(1) - one
        return clip(F.col(f"g_{k}"), low, 1.0)

    def pi(self, k: int) -> Column:
        return clip(F.col(f"pi_{k}"), self.nuisance_low, 1.0) if self.has_delta else lit(1)

    def qz(self, k: int) -> Column:
        if self.z is None:
            return lit(1)
        p = F.col(f"qz_{k}")
        return clip(p if self.z == 1 else lit(1) - p, self.nuisance_low, 1.0)

    def keep(self) -> Column:
        return lit(1) if self.z is None else indicator(F.col("z") == self.z)

    def weight(self, k: int, low: float | None = None) -> Column:
        """Inverse probability of being seen in arm k."""
        return lit(1) / (self.g(k, low) * self.pi(k) * self.qz(k))


def auto_bound(n: float) -> float:
    """5 / (sqrt(n) ln n), below one half."""
    return min(5 / (math.sqrt(n) * math.log(n)), 0.49)


def _mean(s: Setting) -> list[Component]:
    return [Component(s.names[k], indicator(F.col("a") == k) * s.keep() * s.weight(k), {b: s.weight(k) if b == k else lit(0) for b in range(s.arms)}) for k in range(s.arms)]


def _conditional(s: Setting, on_treated: bool) -> list[Component]:
    low, r = s.conditional_low, s.reference
    out = []
    for k in (k for k in range(s.arms) if k != r):
        share = lit(s.fractions[k if on_treated else r])
        up = (lit(1) if on_treated else s.g(r, low) / s.g(k, low)) / s.pi(k) / share
        down = (s.g(k, low) / s.g(r, low) if on_treated else lit(1)) / s.pi(r) / share
        at = {b: up if b == k else -down if b == r else lit(0) for b in range(s.arms)}
        out.append(Component(s.names[k], indicator(F.col("a") == k) * up - indicator(F.col("a") == r) * down, at))
    return out


def _regime(s: Setting) -> list[Component]:
    out = []
    for name, density in s.regimes.items():
        at = {k: density[k] * s.weight(k) for k in range(s.arms)}
        out.append(Component(name, s.keep() * by_code(F.col("a"), [at[k] for k in range(s.arms)]), at))
    return out


def tilt_parts(delta: float, g1: Column) -> tuple[Column, Column, Column, Column, Column]:
    """(q0, q1, h0, h1, dq/dg) of an odds tilt, at the mechanism as it is: a tilt needs no truncation."""
    d = lit(delta) * g1 + (lit(1) - g1)
    return (lit(1) - g1) / d, lit(delta) * g1 / d, lit(1) / d, lit(delta) / d, lit(delta) / (d * d)


def _tilt(s: Setting) -> list[Component]:
    if s.arms != 2:
        raise CapabilityError("odds tilts need a binary treatment")
    out = []
    for name, delta in s.tilts.items():
        _, _, h0, h1, _ = tilt_parts(delta, F.col("g_1"))
        at = {0: h0 / s.pi(0), 1: h1 / s.pi(1)}
        out.append(Component(name, by_code(F.col("a"), [at[0], at[1]]), at))
    return out


def _msm(s: Setting) -> list[Component]:
    out = []
    for term in s.basis:
        at = {k: s.model_weights[k] * s.design[term, k] * s.weight(k) for k in range(s.arms)}
        out.append(Component(term, by_code(F.col("a"), [at[k] for k in range(s.arms)]), at))
    return out


GROUPS: dict[str, Callable[[Setting], list[Component]]] = {
    "mean": _mean,
    "att": lambda s: _conditional(s, True),
    "atc": lambda s: _conditional(s, False),
    "regime": _regime,
    "ipsi": _tilt,
    "msm": _msm,
}


def register_group(name: str, builder: Callable[[Setting], list[Component]], *, replace: bool = False) -> None:
    if name in GROUPS and not replace:
        raise StudyError(f"the group {name!r} is registered already")
    GROUPS[name] = builder


def weighted_form(components: Sequence[Component]) -> tuple[list[Component], list[Column]]:
    """Signs as covariates, and the magnitudes that go into the loss weight."""
    signed = [Component(c.name, F.signum(c.observed), {k: F.signum(v) for k, v in c.at.items()}) for c in components]
    return signed, [F.abs(c.observed) for c in components]


def stratified(components: Sequence[Component], strata: Mapping[str, float]) -> list[Component]:
    """One block of components per stratum: the covariate within it over the stratum's share."""
    out = []
    for s, share in strata.items():
        inside = indicator(F.col("s") == s) / lit(share)
        out += [Component(f"{c.name}|{s}", inside * c.observed, {k: inside * v for k, v in c.at.items()}) for c in components]
    return out


def tilt_support(df: DataFrame, tilts: Mapping[str, float], extreme: float = 0.01) -> DataFrame:
    """Per odds tilt: extremes and effective size of the ratio of the tilted to the natural mechanism, and the weighted share of rows near 0 or 1, where a tilt moves nothing."""
    done = None
    for name, delta in tilts.items():
        _, _, h0, h1, _ = tilt_parts(delta, F.col("g_1"))
        ratio = by_code(F.col("a"), [h0, h1])
        part = df.select(ratio.alias("r"), F.col("g_1").alias("g"), F.col("w")).agg(
            F.min("r").alias("min_ratio"), F.max("r").alias("max_ratio"), (F.sum(F.col("w") * F.col("r")) ** 2 / F.sum((F.col("w") * F.col("r")) ** 2)).alias("effective_n"),
            (F.sum(F.col("w") * indicator(F.least("g", lit(1) - F.col("g")) < extreme)) / F.sum("w")).alias("extreme"),
        )
        part = part.select(F.lit(name).alias("tilt"), "*")
        done = part if done is None else done.unionByName(part)
    return done


def check_support(df: DataFrame, regimes: Mapping[str, Sequence[Column]], arms: int, thresholds: Sequence[float] = (0.01, 0.025, 0.05, 0.1)) -> DataFrame:
    """Per regime: least supported g, extremes and effective size of the ratio, tail mass and unsupported rows."""
    done = None
    for name, density in regimes.items():
        g = by_code(F.col("a"), [F.col(f"g_{k}") for k in range(arms)])
        ratio = by_code(F.col("a"), list(density)) / g
        least = F.least(*(F.when(density[k] > 0, F.col(f"g_{k}")).otherwise(lit(1)) for k in range(arms)), lit(1))
        part = df.select(ratio.alias("r"), least.alias("m"), F.col("w")).agg(
            F.min("m").alias("min_g"), F.max("r").alias("max_ratio"), lit(quantiles(df, ratio, (0.99,))[0]).alias("ratio_q99"),
            (F.sum(F.col("w") * F.col("r")) ** 2 / F.sum((F.col("w") * F.col("r")) ** 2)).alias("effective_n"), F.sum(F.when(F.col("m") <= 0, 1).otherwise(0)).alias("unsupported"),
            *((F.sum(F.col("w") * indicator(F.col("m") < t)) / F.sum("w")).alias(f"below_{str(t)[2:]}") for t in thresholds),
        )
        part = part.select(F.lit(name).alias("regime"), "*")
        done = part if done is None else done.unionByName(part)
    return done


