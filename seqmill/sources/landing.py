"""Landing: rows are added to a folder once each, by key; a run that broke off is gone on with.

``path/rows/run=N`` holds what run N brought, ``path/keys/run=N`` its keys with digests of the contents.
A run counts once its keys are complete, which is the last thing that it writes; what a broken run left
is written over by the next. All paths are of Spark's file systems.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _runs(spark: SparkSession, path: str) -> list[int]:
    """Runs that are complete."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/keys")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at)]
    done = [p.getName() for p in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(name.removeprefix("run=")) for name in done if name.startswith("run="))


def keys(spark: SparkSession, path: str) -> DataFrame | None:
    """``key, digest, run`` of all that has landed; None before the first run."""
    done = _runs(spark, path)
    return spark.read.option("basePath", f"{path}/keys").parquet(*[f"{path}/keys/run={n}" for n in done]) if done else None


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows that have landed, with their ``run``."""
    done = _runs(spark, path)
    return spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/run={n}" for n in done]) if done else None


def land(found: DataFrame, path: str, key: str, content: str) -> dict[str, int]:
    """Add the rows of ``found`` whose key has not landed yet; of rows of one key the one with the smallest digest.

    Returns how many were new and how many contents among them no earlier run had, both seen on the way
    to the file. Null keys land nowhere. A run without new rows leaves nothing.
    """
    spark = found.sparkSession
    before = keys(spark, path)
    own, digest = F.col(f"`{key}`"), F.sha2(F.col(f"`{content}`").cast("binary"), 256)
    new = found.where(own.isNotNull())
    if before is not None:
        new = new.join(before.select(F.col("key").alias(key)), key, "left_anti")
    # the first of each key by an aggregate, which combines within tasks
    marked = new.withColumn("__digest", F.coalesce(digest, F.lit("")))
    columns = [c for c in marked.columns if c != key]
    first = marked.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), "__digest").alias("__row")).select(key, "__row.*")
    seen = Observation()
    run = max(_runs(spark, path), default=-1) + 1
    first.observe(seen, F.count(F.lit(1)).alias("new")).write.mode("overwrite").parquet(f"{path}/rows/run={run}")
    if not seen.get["new"]:
        return {"run": run, "new": 0, "contents": 0}
    written = spark.read.parquet(f"{path}/rows/run={run}").select(F.col(f"`{key}`").alias("key"), F.col("__digest").alias("digest"))
    contents = written.select("digest").distinct()
    contents = contents.join(before.select("digest"), "digest", "left_anti").count() if before is not None else contents.count()
    written.write.mode("overwrite").parquet(f"{path}/keys/run={run}")
    return {"run": run, "new": seen.get["new"], "contents": contents}
