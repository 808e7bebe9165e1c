"""Flat token arrays: all sequences end to end as one array, stored in pieces that say where they start.

A piece is a sequence; readers take any stretch of the array by position, so scans are lazy, split and
pruned like any table's. The description beside the array is one row of JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmill.operators.augment import positions, windows


def write(df: DataFrame, order: str, tokens: str, path: str, **about: object) -> int:
    """Write ``df``'s token arrays in the order of the unique column ``order``; returns the length of the whole."""
    starts, total = positions(df.select(order, F.coalesce(F.size(tokens), F.lit(0)).alias("__n")), order, "__n")
    pieces = df.select(order, F.col(tokens).alias("tokens")).join(starts.where("__n > 0").select(order, "start"), order).select("start", (F.col("start") + F.size("tokens")).alias("stop"), "tokens")
    pieces.repartitionByRange("start").sortWithinPartitions("start").write.mode("overwrite").parquet(f"{path}/array")
    row = {"tokens": total, **about}
    spark = df.sparkSession
    spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return total


def meta(spark: SparkSession, path: str) -> dict:
    return spark.read.json(f"{path}/meta").first().asDict()


def read(spark: SparkSession, path: str) -> DataFrame:
    """``start, stop, tokens``: the pieces of an array."""
    return spark.read.parquet(f"{path}/array")


def stretch(spark: SparkSession, path: str, begin: int, n: int) -> DataFrame:
    """``position, token`` of n places from ``begin`` on; row groups outside are skipped by their bounds."""
    pieces = read(spark, path).where((F.col("start") < begin + n) & (F.col("stop") > begin))
    flat = pieces.select("start", F.posexplode("tokens").alias("k", "token")).select((F.col("start") + F.col("k")).alias("position"), "token")
    return flat.where(F.col("position").between(begin, begin + n - 1))


def read_windows(spark: SparkSession, path: str, size: int, pad: int = 0) -> DataFrame:
    """Training windows of the array, as windows() cuts them."""
    return windows(read(spark, path).withColumnRenamed("start", "place"), "place", "tokens", size, pad)
