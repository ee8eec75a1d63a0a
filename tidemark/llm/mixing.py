"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target in words: the total is shared by weight, a target stops at ``MOST`` times its
source's size, and what is cut off is shared again by weight among the others until none is above.  The
whole part of target / size is complete epochs of every document.  The remainder is a weighted sample
without replacement: every document draws the exponential key -ln(u) / quality, documents are taken in the
order of their keys while their running size fits, and one more document, the one whose size is nearest to
what is still missing, closes the gap.

The running sums never need a source in one task: keys are cut into slices by their logarithm, slices are
summed first, and rows are only sorted within the slice in which a budget ends.  Whatever the qualities, at most
0.255 of a source's keys lie between a number and its double: the logarithm of an exponential variable has no
denser octave, at any rate, and a mixture of rates is no denser than its densest part.  So octaves are cut into
as many slices as the source's rows ask for, and no slice is expected to hold more than ``SLICE_ROWS``.  u is
taken from a digest of the id, the text and the source, so reruns agree.

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null or non-positive
quality counts as ``LEAST_QUALITY``.  Documents of size 0 are taken 0 times.  Repeated rows are separate
documents; rows that agree in everything share a key and are told apart only by position in the running sum,
and one of them, not all, may close a gap.  Texts of any length are counted whole.  An empty table gives an
empty result.  Extra columns, also those whose names differ by case only, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, discard, pick, written

MOST = 3.0
WEIGHTS = (5.0, 2.0, 1.0)
LEAST_QUALITY = 0.05
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
#: Rows a slice of keys should have; the number of slices follows the source.  Slices are summed in blocks.
SLICE_ROWS, BLOCK_SLICES = 1_000, 256
#: The greatest share of the keys in an octave: the density of -ln(u)'s logarithm is 1/e at most, times ln 2.
OCTAVE = 0.2551


def words(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """A cheap document quality in (0, 1]: the share of letters and spaces among all characters."""
    n = F.length(text)
    odd = F.length(F.translate(text, "0123456789#$%&*|!<>{}[]()=+/\\_~^@\"'", ""))
    return F.when(n > 0, F.greatest(odd / n, F.lit(LEAST_QUALITY))).otherwise(F.lit(LEAST_QUALITY))


def shares(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat in code-point order, null last.

    Targets are a water level: sources are capped in the order of size over weight, and the level is the one
    at which the rest shares what the capped ones leave.  One row per source comes in, so one task suffices.
    """
    ordered = sizes.withColumn("i", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ordered = ordered.withColumn("weight", F.element_at(cycle, (F.col("i") % len(weights) + 1).cast("int")))
    before = W.orderBy(F.col("source_size") / F.col("weight"), "i").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    capped = F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(whole) - capped) / left
    tried = ordered.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= most * F.col("source_size"))
    # The first source in that order whose share fits sets the level; those before it are capped.
    tried = tried.withColumn("first", F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), "i", "level"))).over(whole)["level"])
    target = F.least(F.coalesce(F.col("first") * F.col("weight"), most * F.col("source_size")), most * F.col("source_size"))
    return tried.select("source", "source_size", target.alias("target"))


def mark_of(id_col: str, text_col: str, source_col: str, seed: int = SEED) -> Column:
    """A number of 60 bits from a digest of id, text and source."""
    parts = (F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in (id_col, text_col, source_col))
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts, F.lit(str(seed)))), 1, 15), 16, 10).cast("long")


def _small(df: DataFrame) -> DataFrame:
    """``df``, a written table, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _running(parts: DataFrame) -> DataFrame:
    """``parts`` (source, slice, part) with ``ahead``, the sum of the slices before: by blocks, then within blocks."""
    parts = parts.withColumn("block", F.floor(F.col("slice") / BLOCK_SLICES))
    before = lambda w: F.coalesce(F.sum("part").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = parts.groupBy("source", "block").agg(F.sum("part").alias("part")).withColumn("far", before(W.partitionBy("source").orderBy("block")))
    blocks = written(blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), "far"), "blocks")
    near = parts.withColumn("near", before(W.partitionBy("source", "block").orderBy("slice")))
    out = near.join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    return out.select("source", "slice", "part", (F.col("near") + F.col("far")).alias("ahead"))


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST,
    seed: int = SEED,
) -> DataFrame:
    """One row (doc_id, source, mark, size, source_size, target, epochs, picked, taken) per row of ``df``.

    ``quality`` is an expression over a column ``text``.  ``mark`` is a hash of id, text and source that tells
    documents with equal ids apart.  A document is to be repeated epochs + picked times.
    """
    docs = pick(df, id_col, text_col, source_col).toDF("doc_id", "text", "source")
    grade = F.coalesce(quality if quality is not None else text_quality(F.col("text")), F.lit(LEAST_QUALITY))
    mark = mark_of("doc_id", "text", "source", seed)
    # 2**-53 to 1: never 0, so its logarithm is finite.
    u = (F.shiftright(mark, 7) + F.lit(1)) / F.lit(float(2**53))
    docs = docs.select("doc_id", "source", mark.alias("mark"), words(F.col("text")).alias("size"), (-F.log(u) / F.greatest(grade, F.lit(LEAST_QUALITY))).alias("key"))
    docs = written(docs, "sizes")
    sizes = written(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    goals = written(shares(sizes.select("source", "source_size"), weights, most), "targets")
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    goals = goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    cuts = _small(sizes.select(F.col("source").alias("s"), F.ceil(F.col("n") * OCTAVE / SLICE_ROWS).alias("cuts"), (F.col("n") > SLICE_ROWS).alias("many")))
    place = F.when(F.col("many"), F.floor(F.log2(F.greatest(F.col("key"), F.lit(2.0**-60))) * F.col("cuts"))).otherwise(0)
    cut = docs.join(cuts, F.col("source").eqNullSafe(F.col("s"))).withColumn("slice", place.cast("long")).drop("s", "cuts", "many")
    summed = written(cut.groupBy("source", "slice").agg(F.sum("size").alias("part")), "parts")
    parts = _running(summed)
    parts = parts.join(_small(goals), parts["source"].eqNullSafe(goals["source"])).select(parts["source"], "slice", "part", "ahead", "source_size", "target", "epochs", "rest")
    parts = written(parts, "slices")
    same = parts["source"].eqNullSafe(cut["source"]) & (parts["slice"] == cut["slice"])
    placed = cut.join(parts, same).select(cut["doc_id"], cut["source"], "mark", "size", "key", cut["slice"], "ahead", "part", "source_size", "target", "epochs", "rest")

    # Only the slice in which the budget ends has to be sorted: the others are taken or left whole.
    split = (F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("part") > F.col("rest"))
    placed = written(placed.withColumn("split", split), "placed")
    order = W.partitionBy("source", "slice").orderBy("key", "doc_id", "mark", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = placed.where("split").withColumn("run", F.col("ahead") + F.sum("size").over(order)).withColumn("picked", (F.col("run") <= F.col("rest")).cast("int"))
    even = placed.where("not split").withColumn("run", F.lit(0).cast("long")).withColumn("picked", (F.col("ahead") + F.col("part") <= F.col("rest")).cast("int"))
    chosen = written(edge.unionByName(even), "chosen")
    discard(docs, summed, parts, placed)

    # The gap that is left, and the document not yet picked whose size is nearest to it.
    got = written(chosen.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("picked") * F.col("size")).alias("got")), "got")
    open_ = chosen.where("picked = 0 and size > 0").join(_small(got), F.col("source").eqNullSafe(F.col("s")))
    gap = F.col("rest") - F.col("got")
    nearest = open_.where(F.abs(F.col("size") - gap) < gap).groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - gap).alias("off"), "key", "doc_id", "mark")).alias("best"))
    nearest = _small(written(nearest.select(F.col("source").alias("s"), F.col("best.mark").alias("m"), F.col("best.doc_id").alias("d")), "closing"))
    closes = F.col("source").eqNullSafe(F.col("s")) & F.col("mark").eqNullSafe(F.col("m")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("picked") == 0)
    # Of rows that agree in everything one closes the gap.
    nth = F.row_number().over(W.partitionBy("source", "doc_id", "mark").orderBy("size"))
    closing = chosen.join(nearest, closes).withColumn("picked", (nth == 1).cast("int")).select(*chosen.columns)
    out = chosen.join(nearest, closes, "left_anti").unionByName(closing)
    out = out.withColumn("picked", F.when(F.col("size") > 0, F.col("picked")).otherwise(0)).withColumn("taken", (F.col("epochs") + F.col("picked")) * F.col("size"))
    return out.select("doc_id", "source", "mark", "size", "source_size", "target", "epochs", "picked", "taken")
