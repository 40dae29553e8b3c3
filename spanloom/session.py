"""What a session needs before Python runs on its executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, deleted when the process ends; only a local session may lack one and gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again; it is deleted when the process ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is already gone; the folder's owner cleans up
        return


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each context, so that they need no copy of their own.

    Rows go to Python ``BATCH_ROWS`` at once unless the session says otherwise: texts can be long, and a batch of
    Spark's 10,000 is held several times over on its way.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)
    context = spark.sparkContext
    if getattr(context, "_spanloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spanloom-")) / "spanloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._spanloom_shipped = True
