"""Exact order statistics and quantiles without gathering a column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import lit

#: Up to so many rows, values are counted and gathered at once.
FEW_ROWS = 200_000


def order_statistics(df: DataFrame, column: Column | str, ranks: Sequence[int], n: int | None = None) -> list[float]:
    """The values at 0-based ascending ranks of the non-null values of a column.

    A sketch brackets every rank; rows below a bracket are counted, and only the values within the brackets,
    a bounded share of the rows, are gathered with their counts.
    """
    rows = df.select((F.col(column) if isinstance(column, str) else column).cast("double").alias("v")).where("v is not null")
    n = rows.count() if n is None else n
    if not n:
        return [math.nan] * len(ranks)
    if n <= FEW_ROWS:
        held = sorted((r["v"], r["count"]) for r in rows.groupBy("v").count().collect())
        return [_at(held, 0, k) for k in ranks]
    accuracy = max(10_000, 4 * n // FEW_ROWS)
    sides = [min(max((k + d * 2 * n / accuracy) / n, 0.0), 1.0) for k in ranks for d in (-1, 1)]
    found = rows.agg(F.percentile_approx("v", F.array(*(lit(s) for s in sides)), accuracy)).first()[0]
    brackets = list(zip(found[::2], found[1::2], strict=True))
    below = rows.agg(*(F.sum(F.when(F.col("v") < lit(low), 1).otherwise(0)) for low, _ in brackets)).first()
    inside = F.lit(False)
    for low, high in brackets:
        inside = inside | F.col("v").between(lit(low), lit(high))
    held = sorted((r["v"], r["count"]) for r in rows.where(inside).groupBy("v").count().collect())
    return [_at([h for h in held if low <= h[0] <= high], b, k) for k, b, (low, high) in zip(ranks, below, brackets, strict=True)]


def _at(held: Sequence[tuple[float, int]], below: int, rank: int) -> float:
    seen = below
    for value, count in held:
        seen += count
        if rank < seen:
            return value
    return held[-1][0]


def quantiles(df: DataFrame, column: Column | str, probabilities: Sequence[float], n: int | None = None) -> list[float]:
    """Exact quantiles, interpolated between neighbouring order statistics."""
    rows = df.select((F.col(column) if isinstance(column, str) else column).cast("double").alias("v")).where("v is not null")
    n = rows.count() if n is None else n
    if not n:
        return [math.nan] * len(probabilities)
    places = [p * (n - 1) for p in probabilities]
    ranks = sorted({k for x in places for k in (math.floor(x), math.ceil(x))})
    at = dict(zip(ranks, order_statistics(rows, "v", ranks, n), strict=True))
    return [at[math.floor(x)] + (x - math.floor(x)) * (at[math.ceil(x)] - at[math.floor(x)]) for x in places]
