"""Tables of a temporal graph: schemas, validation, statistics, time buckets and vertex ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .storage import stored


def _ints(*names: str) -> list[StructField]:
    return [StructField(n, IntegerType(), False) for n in names]


EDGES = StructType(_ints("src", "dest", "weight", "ts"))
WINDOWS = StructType([StructField("window_id", LongType(), False), *_ints("ts", "te")])
STAIRCASE = StructType(_ints("src", "dest", "weight", "t", "s", "te_from"))
RECTS = StructType(_ints("src", "dest", "weight", "t", "s", "t1", "t2"))
FOREST = StructType([StructField("window_id", LongType(), False), *_ints("src", "dest", "weight", "ts")])
#: The open end of a rectangle.
OPEN = 2**31 - 1
EDGE = ["src", "dest", "weight", "ts"]


def edges(df: DataFrame) -> DataFrame:
    """``df`` as an edge table: the four columns as integers, distinct. A null or negative id or timestamp is an error when read."""
    good = F.col("src").isNotNull() & F.col("dest").isNotNull() & F.col("weight").isNotNull() & F.col("ts").isNotNull()
    good &= (F.col("src") >= 0) & (F.col("dest") >= 0) & (F.col("ts") >= 0)
    checked = F.when(good, F.col("src")).otherwise(F.raise_error(F.lit("an edge needs src, dest and ts of 0 or more and no nulls")))
    return df.select(checked.cast("int").alias("src"), *(F.col(c).cast("int").alias(c) for c in EDGE[1:])).distinct()


def empty_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EDGES)


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: n (largest id + 1), m (edges) and t_count (largest timestamp + 1); gaps count, an empty graph has zeros."""
    return edges.agg(
        F.coalesce(F.greatest(F.max("src"), F.max("dest")) + 1, F.lit(0)).alias("n"),
        F.count("*").alias("m"),
        F.coalesce(F.max("ts") + 1, F.lit(0)).alias("t_count"),
    )


def t_count(edges: DataFrame) -> int:
    return edges.agg(F.max("ts").alias("t")).first()["t"] + 1 if not edges.isEmpty() else 0


def split_point(edges: DataFrame, ratio: float) -> DataFrame:
    """One row: how many timestamps form the base (truncated) and how many are left to append; a base of 0 is legal."""
    total = F.coalesce(F.max("ts") + 1, F.lit(0))
    base = F.floor(total * F.lit(float(ratio))).cast("int")
    return edges.agg(base.alias("n_base"), (total - base).alias("n_stream"))


def edges_per_timestamp(edges: DataFrame) -> DataFrame:
    return edges.groupBy("ts").agg(F.count("*").alias("n_edges"))


def at_timestamp(edges: DataFrame, t: int) -> DataFrame:
    """The edges of one timestamp; none beyond the last one or below 0."""
    return edges.where(F.col("ts") == F.lit(t))


def snapshot(edges: DataFrame, ts: int, te: int) -> DataFrame:
    """The edges whose timestamp lies in the closed window; the comparison reaches the scan."""
    return edges.where(F.col("ts").between(ts, te))


def month_bucket(time: Column, first_year: int) -> Column:
    return (F.year(time) * 12 + F.month(time) - (first_year * 12 + 1)).cast("int")


def quarter_bucket(time: Column, first_year: int) -> Column:
    return (F.year(time) * 4 + F.quarter(time) - (first_year * 4 + 1)).cast("int")


def undirected(edges: DataFrame) -> DataFrame:
    """Every pair once, the smaller id first, without loops."""
    return edges.select(F.least("src", "dest").alias("src"), F.greatest("src", "dest").alias("dest"), *[c for c in edges.columns if c not in ("src", "dest")]).where("src <> dest")


def lightest(edges: DataFrame) -> DataFrame:
    """The least weight of each undirected pair."""
    return undirected(edges).groupBy("src", "dest").agg(F.min("weight").alias("weight"))


def adjacency(edges: DataFrame, multi_edge: bool = False) -> DataFrame:
    """(src, dest, weight) in both directions without loops, the lightest parallel edge alone unless ``multi_edge``."""
    one = undirected(edges).select("src", "dest", "weight") if multi_edge else lightest(edges)
    return one.unionByName(one.select(F.col("dest").alias("src"), F.col("src").alias("dest"), "weight"))


def dense_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    """(id, dense) for the distinct ids in the columns, numbered from 0 in ascending order.

    Range partitions are numbered by their sizes, so no task sees all ids.
    """
    ids = df.select(F.explode(F.array(*columns)).alias("id")).where("id is not null").distinct()
    parts = ids.repartitionByRange("id").sortWithinPartitions("id").select("id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    parts = stored(parts, "ids")
    sizes = parts.groupBy("p").agg(F.count("*").alias("k"), F.min("m").alias("m0"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("p", "m0", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    return parts.join(F.broadcast(bases), "p").select("id", (F.col("m") - F.col("m0") + F.col("base")).alias("dense"))
