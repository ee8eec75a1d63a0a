"""Making this package importable in Spark's Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


#: Rows of a batch that goes to a Python worker: with long texts the default of 10,000 takes much memory on both sides.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application, unless PYTHONPATH already has it.

    Batches for Python workers become ``BATCH_ROWS`` rows where the session has no setting of its own.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if str(_ROOT) in paths or app in _shipped:
        return spark
    archive = Path(tempfile.mkdtemp()) / "tidemark_sources.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((_ROOT / "tidemark").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
    return spark
