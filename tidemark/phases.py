"""Wall-clock by phase: driver timers that also name the Spark jobs started within a phase."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Phases:
    """Seconds and number of entries by phase; phases may nest, and each counts its own whole span."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        context = self.spark.sparkContext
        before = context.getLocalProperty("spark.job.description")
        context.setJobDescription(name)
        began = time.perf_counter()
        try:
            yield
        finally:
            seconds, times = self.held.get(name, (0.0, 0))
            self.held[name] = (seconds + time.perf_counter() - began, times + 1)
            context.setLocalProperty("spark.job.description", before)

    def to_frame(self) -> DataFrame:
        return self.spark.createDataFrame([(k, s, n) for k, (s, n) in self.held.items()], "phase string, seconds double, entries int")
