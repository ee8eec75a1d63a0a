"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as Parquet in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm._common import settle, written
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mark_of, mix_sources
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import classify
from tidemark.llm.toxicity import score_toxicity
from tidemark.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    settle(ship(spark))
    return classify(docs, carry=tuple(COLUMNS[1:])).where("kept").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; it learns from the labels of what is left."""
    settle(ship(spark))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels, carry=tuple(COLUMNS[1:])).where("predicted = 0").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id, nulls last.

    A row is known by its id and a hash of all columns, so null and repeated ids are rows like others; rows
    that agree in every column are one document.
    """
    settle(ship(spark))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*COLUMNS).alias("mark"))
    keyed = docs.select(*COLUMNS, row.alias("row"))
    kept = near_duplicates(keyed, "row").where("kept").select(F.col("doc_id").alias("row"))
    return keyed.dropDuplicates(["row"]).join(kept, "row", "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; most documents come once, so few rows are repeated.

    Rows that agree in id, text and source share evenly what the mix takes of them together.
    """
    settle(ship(spark))
    times = mix_sources(docs).groupBy(F.struct("doc_id", "mark").alias("row")).agg(F.count("*").alias("rows"), F.sum(F.col("epochs") + F.col("picked")).alias("times")).where("times > 0")
    keyed = docs.select(*COLUMNS, F.struct("doc_id", mark_of("doc_id", "text", "source").alias("mark")).alias("row")).join(times, "row")
    nth = F.row_number().over(W.partitionBy("row").orderBy("lang", "n_chars"))
    own = F.floor(F.col("times") / F.col("rows")) + (nth <= F.col("times") % F.col("rows")).cast("int")
    return keyed.withColumn("own", own.cast("int")).where("own > 0").withColumn("n", F.explode(F.sequence(F.lit(1), "own"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    settle(ship(spark))
    return pack_documents(docs, keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("near dedup", near_dedup),
    ("source mix", mix),
    ("packing", pack),
]

#: Classifiers, hashes and a tokenizer are not SQL; the tests hold stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
