"""Batches of query windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def window_size(t_count: int, ratio: float) -> int:
    """End minus start of a generated window, rounded down in double precision."""
    return math.floor((t_count - 1) * ratio)


def generate(spark: SparkSession, count: int, ratio: float, t_count: int, seed: int | None = None) -> DataFrame:
    """``count`` windows of one size, both ends inside 0..t_count-1.

    With a seed starts are random and repeatable; without one they step through the possible starts.
    """
    if t_count < 1:
        return spark.createDataFrame([], "window_id bigint, ts int, te int")
    size = window_size(t_count, ratio)
    places = t_count - size
    ids = spark.range(count).withColumnRenamed("id", "window_id")
    start = F.col("window_id") * 7 % places if seed is None else F.pmod(F.xxhash64(F.lit(seed), "window_id"), F.lit(places))
    return ids.select("window_id", start.cast("int").alias("ts"), (start + size).cast("int").alias("te"))


def all_windows(spark: SparkSession, t_count: int) -> DataFrame:
    """Every window ts <= te, numbered by start and end."""
    pairs = spark.range(t_count).select(F.col("id").cast("int").alias("ts")).withColumn("te", F.explode(F.sequence("ts", F.lit(t_count - 1))))
    return pairs.select((F.col("ts").cast("bigint") * t_count + F.col("te")).alias("window_id"), "ts", "te")


def clip(windows: DataFrame, t_count: int) -> DataFrame:
    """Windows cut to 0..t_count-1; those wholly outside, or with ts > te, are gone, as they have no edges."""
    inside = windows.where((F.col("ts") <= F.col("te")) & (F.col("te") >= 0) & (F.col("ts") < t_count))
    return inside.select("window_id", F.greatest("ts", F.lit(0)).alias("ts"), F.least("te", F.lit(t_count - 1)).alias("te"))


def preview(windows: DataFrame, rows: int = 5) -> tuple[list, list]:
    """The first and the last windows by id; ``rows`` of each."""
    return windows.orderBy("window_id").limit(rows).collect(), windows.orderBy(F.desc("window_id")).limit(rows).collect()
