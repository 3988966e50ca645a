"""The canonical edge order: lighter first, newer first among equals, then by ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def canonical() -> list[Column]:
    return [F.col("weight").asc(), F.col("ts").desc(), F.col("src").asc(), F.col("dest").asc()]


def canonical_sort(edges: DataFrame) -> DataFrame:
    return edges.orderBy(*canonical())


def by_timestamp(edges: DataFrame) -> DataFrame:
    """Globally sorted by timestamp through a range exchange."""
    return edges.repartitionByRange("ts").sortWithinPartitions("ts")


def canonical_rank(edges: DataFrame, key: str) -> DataFrame:
    """Each edge's place in the canonical order among those of its key, from 1."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*canonical())))


def rectangle_sort(rects: DataFrame) -> DataFrame:
    """Within partitions by t1, t2 descending, s, t descending: the order in which files of rectangles are skipped best."""
    return rects.sortWithinPartitions("t1", F.desc("t2"), "s", F.desc("t"))


def merge_sorted(left: DataFrame, right: DataFrame) -> DataFrame:
    return canonical_sort(left.unionByName(right))


def systematic_sample(edges: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """Every k-th undirected edge in the order of src, dest, weight, ts, with k = edges // count, at most ``count``, in a seeded random order."""
    one = edges.select(F.least("src", "dest").alias("src"), F.greatest("src", "dest").alias("dest"), "weight", "ts").where("src <> dest").distinct()
    step = max(1, one.count() // max(1, count))
    placed = numbered(one, ["src", "dest", "weight", "ts"])
    return placed.where((F.col("row") % step == 0) & (F.col("row") < step * count)).drop("row").orderBy(F.xxhash64(F.lit(seed), "src", "dest", "weight", "ts"))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``row`` from 0 in the order given: ranks within range partitions plus the sizes of those before."""
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts = stored(parts, "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranks = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("row", ranks).join(F.broadcast(bases), "_part").withColumn("row", F.col("row") + F.col("_base")).drop("_part", "_base")
