"""Small helpers that the operators share: durable intermediate tables and broadcast size checks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The largest table, in rows, that an operator may hand to every executor.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, which all executors see.

    Only a local master without that setting gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(made)  # the setting itself cannot change in a running session
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_to = path  # what ``discard`` deletes
    return made


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` that no plan reads any more: what was made of them is itself written."""
    for df in frames:
        path = getattr(df, "_written_to", None)
        if path is None:
            raise ValueError("only tables made by written() are discarded")
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def settle(spark: SparkSession) -> None:
    """Give back what ended plans still hold on the driver, before the next ones add to it.

    Plans that Python no longer refers to are collected in both processes, and with them Spark deletes their shuffle
    files and broadcasts; the JVM shrinks its heap, Arrow and the C library return free pages of the Python process.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)
    spark._jvm.System.gc()


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by exact spelling first, so clashing extra columns do no harm."""
    places = []
    for name in names:
        exact = [i for i, c in enumerate(df.columns) if c == name]
        loose = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not (exact or loose):
            raise ValueError(f"no column {name!r} among {df.columns}")
        places.append((exact or loose)[0])
    flat = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return flat.select(*(flat[f"c{i}"].alias(f"{k} {n}") for k, (i, n) in enumerate(zip(places, names, strict=True)))).toDF(*names)


def no_clash(carry: tuple[str, ...], *outputs: str) -> None:
    """Refuse carried columns that are named like columns of the result."""
    both = {c.lower() for c in carry} & {c.lower() for c in outputs}
    if both or len({c.lower() for c in carry}) < len(carry):
        raise ValueError(f"carried columns clash: {sorted(both) or carry}")
