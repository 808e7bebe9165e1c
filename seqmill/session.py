"""Session helpers: input tables, shared scratch tables, and shipping the package to executors."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; Spark reads the path, so any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset (tests, local mode) a temporary folder stands in.
    """
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="seqmill-")
    return f"file://{_LOCAL}"


_LOCAL: str | None = None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/seqmill/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(*names: str) -> list[str]:
    """Column names that no table has."""
    mark = uuid.uuid4().hex[:12]
    return [f"{n}_{mark}" for n in names]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that they need no install."""
    context = spark.sparkContext
    if getattr(context, "_seqmill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.writestr(zipfile.ZipInfo(str(p.relative_to(root.parent))), p.read_bytes())
        name = f"seqmill-{hashlib.sha256(data.getvalue()).hexdigest()[:16]}.zip"
        path = os.path.join(tempfile.mkdtemp(prefix="seqmill-ship-"), name)
        Path(path).write_bytes(data.getvalue())
        context.addPyFile(path)
    context._seqmill_shipped = True


#: What a Python worker gets at once: rows of text can be long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, unless the session has settings of its own."""
    for key, value in BATCHES.items():
        if not spark.conf._jconf.contains(key):
            spark.conf.set(key, value)
