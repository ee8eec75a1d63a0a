"""Reading tables, durable intermediate tables, and results as Parquet with a JSON manifest."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_frame(spark: SparkSession, data: Any) -> DataFrame:
    """A Spark frame from whatever holds a table: a Spark frame, pandas, Arrow, a mapping of columns, or a path.

    Paths say their format by their ending (parquet, orc, json, csv); one without an ending is Parquet.
    """
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, str):
        kind = data.rstrip("/").rsplit(".", 1)[-1].lower() if "." in data.rsplit("/", 1)[-1] else "parquet"
        if kind == "csv":
            return spark.read.csv(data, header=True, inferSchema=True)
        if kind not in ("parquet", "orc", "json"):
            raise ValueError(f"no reader for {data!r}")
        return spark.read.format(kind).load(data)
    if isinstance(data, Mapping):
        import pandas as pd

        return spark.createDataFrame(pd.DataFrame(dict(data)))
    return spark.createDataFrame(data)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master without it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(made)  # the setting itself cannot change in a running session
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Write and read back: what an alternation does each round, so that its lineage does not grow."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._written_to = path  # what ``discard`` deletes
    return made


def discard(df: DataFrame) -> None:
    """Delete a table made by ``durable`` that no plan reads any more: what was made of it is itself written."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    place = jvm.org.apache.hadoop.fs.Path(df._written_to)
    place.getFileSystem(conf).delete(place, True)


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: StructType) -> DataFrame:
    """A frame of rows that the driver holds, handed over as Arrow, so that it is part of the plan and needs no job."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    try:
        columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(schema.fields)]
        return spark.createDataFrame(pa.Table.from_arrays(columns, schema.names), schema)
    except (pa.ArrowException, TypeError, PySparkException):  # a type that Arrow has in another form
        return spark.createDataFrame(rows, schema)


def fingerprint(df: DataFrame) -> str:
    """A digest of the rows that does not depend on their order."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in df.columns))
    part = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    r = df.agg(F.count("*"), F.sum(part)).first()
    return f"{r[0]}:{r[1]}"


def save_result(result: Any, path: str, **manifest: Any) -> None:
    """Estimates and curves as Parquet, settings as one line of JSON; nothing is pickled."""
    spark = result.rows.sparkSession
    result.to_frame().write.mode("overwrite").parquet(f"{path}/estimates")
    result.influence_frame().write.mode("overwrite").parquet(f"{path}/curves")
    facts = {"estimates": [asdict(e) for e in result.estimates], "covariance": result.cov.tolist(), "n": result.estimates[0].n, "spark": spark.version} | manifest
    spark.createDataFrame([(json.dumps(facts, default=str),)], "json string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_result(spark: SparkSession, path: str) -> dict[str, Any]:
    """{estimates, curves, manifest} of a saved result."""
    facts = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return {"estimates": spark.read.parquet(f"{path}/estimates"), "curves": spark.read.parquet(f"{path}/curves"), "manifest": facts}


def provenance(df: DataFrame, *, seed: int, folds: int) -> dict[str, Any]:
    spark = df.sparkSession
    return {"spark": spark.version, "seed": seed, "folds": folds, "data": fingerprint(df), "run_id": uuid.uuid4().hex}
