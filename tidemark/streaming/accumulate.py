"""Running sufficient statistics of a stream: the sums behind cell means and linear fits are mergeable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_statistics(df: DataFrame, cells: Sequence[Column], y: Column, w: Column) -> DataFrame:
    """(cell_0.., sw, swy, swyy): what a saturated regression and its variance need."""
    keys = [c.alias(f"cell_{i}") for i, c in enumerate(cells)]
    rows = df.select(*keys, w.alias("w"), y.alias("y"))
    return rows.groupBy(*(f"cell_{i}" for i in range(len(cells)))).agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("y")).alias("swy"), F.sum(F.col("w") * F.col("y") ** 2).alias("swyy"))


class Accumulator:
    """A ``foreachBatch`` sink: each micro-batch writes its sums under its batch number, so a replayed batch replaces itself."""

    def __init__(self, path: str, cells: Sequence[Column], y: Column, w: Column):
        self.path, self.cells, self.y, self.w = path, cells, y, w

    def __call__(self, batch: DataFrame, number: int) -> None:
        cell_statistics(batch, self.cells, self.y, self.w).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def means(self, spark) -> DataFrame:
        """(cell_0.., n, mean) over all batches so far."""
        keys = [f"cell_{i}" for i in range(len(self.cells))]
        return spark.read.parquet(self.path).groupBy(*keys).agg(F.sum("sw").alias("n"), (F.sum("swy") / F.sum("sw")).alias("mean"))
