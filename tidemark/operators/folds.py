"""Deterministic cross-fitting partitions: a column ``fold`` that depends on ids and a seed alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CapabilityError, StudyError


def hash32(key: Column, seed: int = 0) -> Column:
    """The first 32 bits of the md5 of a key; the same in any engine that has md5."""
    text = key.cast("string") if not seed else F.concat(key.cast("string"), F.lit(f"/{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def with_folds(df: DataFrame, n_folds: int, *, seed: int = 0, stratify: str | None = None, cluster: str | None = None, key: str = "id") -> DataFrame:
    """Add ``fold``.

    Without strata it is a hash of the id or the cluster modulo n_folds: map-only, and a cluster is never split.
    With strata, units (clusters by their least stratum) are dealt in turn in the order of their hash within a
    stratum; ranks are counted within 4096 hash ranges first, so no stratum has to be sorted in one task.
    """
    if n_folds < 2:
        raise StudyError("cross-fitting needs two folds at least")
    unit = cluster or key
    if stratify is None:
        return df.withColumn("fold", (hash32(F.col(unit), seed) % n_folds).cast("int"))
    from pyspark.sql import Window as W

    units = df.groupBy(F.col(unit).alias("u")).agg(F.min(stratify).alias("g")) if cluster else df.select(F.col(unit).alias("u"), F.col(stratify).alias("g"))
    units = units.withColumn("h", hash32(F.col("u"), seed)).withColumn("part", F.shiftright("h", 20))
    parts = units.groupBy("g", "part").agg(F.count("*").alias("c"))
    parts = parts.withColumn("ahead", F.coalesce(F.sum("c").over(W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("c")
    units = units.withColumn("r", F.row_number().over(W.partitionBy("g", "part").orderBy("h", "u")) - 1)
    units = units.join(parts, ["g", "part"]).select(F.col("u").alias(unit), ((F.col("r") + F.col("ahead")) % n_folds).cast("int").alias("fold"))
    return df.join(units, unit)


def resolve_n_folds(df: DataFrame, n_folds: int, stratify: str | None = None) -> int:
    """At most the size of the rarest stratum; fewer than two are refused."""
    least = df.count() if stratify is None else df.groupBy(stratify).count().agg(F.min("count")).first()[0]
    if least < 2:
        raise StudyError("a stratum with one unit cannot be cross-fitted")
    return min(n_folds, least)


def split_clusters(df: DataFrame, cluster: str) -> DataFrame:
    """Clusters that lie in more than one fold; empty for a partition that may be used."""
    return df.groupBy(cluster).agg(F.count_distinct("fold").alias("folds")).where("folds > 1")


def check_integrity(df: DataFrame, n_folds: int, cluster: str | None = None) -> dict[str, int]:
    """{rows without a fold, folds without a row, folds out of range, clusters in more than one fold}: all zero in a partition that may be used."""
    r = df.agg(F.sum(F.when(F.col("fold").isNull(), 1).otherwise(0)), F.count_distinct(F.when((F.col("fold") >= 0) & (F.col("fold") < n_folds), F.col("fold"))), F.count_distinct(F.when((F.col("fold") < 0) | (F.col("fold") >= n_folds), F.col("fold")))).first()
    return {"unassigned": int(r[0] or 0), "empty": n_folds - r[1], "out_of_range": r[2], "split": split_clusters(df, cluster).count() if cluster else 0}


def refuse_scheme(kind: str) -> None:
    """Time-blocked and rolling-origin folds would change what out-of-fold means here."""
    if kind not in ("stratified", "plain", "grouped"):
        raise CapabilityError(f"folds of the kind {kind!r} are not available")
