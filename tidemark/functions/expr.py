"""Scalar building blocks of the estimators, as Spark columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Probabilities stay this far from 0 and 1 in a logistic fluctuation.
ALPHA = 0.9995


def lit(x: float) -> Column:
    """A double literal: decimals would change results in the sixth digit."""
    return F.lit(float(x)).cast("double")


def expit(x: Column) -> Column:
    return lit(1) / (lit(1) + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (lit(1) - p))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, lit(high)), lit(low))


def shrink(p: Column, alpha: float = ALPHA) -> Column:
    return clip(p, 1 - alpha, alpha)


def safe_logit(p: Column, alpha: float = ALPHA) -> Column:
    return logit(shrink(p, alpha))


def indicator(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0; null counts as not."""
    return F.when(condition, lit(1)).otherwise(lit(0))


def total(columns: Iterable[Column], start: float = 0.0) -> Column:
    columns = list(columns)
    return reduce(lambda a, b: a + b, columns) if columns else lit(start)


def wsum(weight: Column, value: Column) -> Column:
    return F.sum(weight * value)


def quasi_loglik(y: Column, p: Column) -> Column:
    """Bernoulli log-likelihood, also for fractional outcomes."""
    return y * F.log(p) + (lit(1) - y) * F.log(lit(1) - p)


def code_of(column: Column, levels: Sequence) -> Column:
    """Rank of a label among its levels; null where it is none of them."""
    out = F.when(column == F.lit(levels[0]), F.lit(0))
    for k, level in enumerate(levels[1:], 1):
        out = out.when(column == F.lit(level), F.lit(k))
    return out


def by_code(code: Column, values: Sequence[Column]) -> Column:
    """values[code], as one expression."""
    out = F.when(code == 0, values[0])
    for k, v in enumerate(values[1:], 1):
        out = out.when(code == k, v)
    return out
