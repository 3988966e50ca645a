"""Temporal graphs from the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import EDGE, month_bucket, quarter_bucket

FIRST_YEAR = 1995


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str, unit: str = "quarter") -> DataFrame:
    """One edge a sale between the nations of supplier and customer, weighted by the whole price; 25 vertices."""
    line = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    supplier = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customer = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dest"))
    bucket = (quarter_bucket if unit == "quarter" else month_bucket)(F.col("l_shipdate"), FIRST_YEAR)
    joined = line.join(supplier, "l_suppkey").join(orders.join(customer, "o_custkey"), "l_orderkey").where("src <> dest")
    return joined.select(F.col("src").cast("int").alias("src"), F.col("dest").cast("int").alias("dest"), F.floor("l_extendedprice").cast("int").alias("weight"), bucket.alias("ts")).distinct()


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts, bipartite: part ids follow the supplier ids; weights are whole prices, timestamps months."""
    line = _read(spark, sf_dir, "lineitem")
    first = line.agg((F.max("l_suppkey") + 1).alias("n1"))
    rows = line.crossJoin(F.broadcast(first))  # one row
    return rows.select(F.col("l_suppkey").cast("int").alias("src"), (F.col("n1") + F.col("l_partkey")).cast("int").alias("dest"), F.floor("l_extendedprice").cast("int").alias("weight"), month_bucket(F.col("l_shipdate"), FIRST_YEAR).alias("ts")).distinct()


def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of consecutive events of a day, in the order of time and id, weighted by hundredths of the value; timestamps are days."""
    events = _read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    first = events.agg(F.min("day").alias("day0"))
    before = F.lag("user_id").over(Window.partitionBy("day").orderBy("ts", "event_id"))
    rows = events.crossJoin(F.broadcast(first)).withColumn("before", before).where("before is not null and before <> user_id")
    return rows.select(F.col("before").cast("int").alias("src"), F.col("user_id").cast("int").alias("dest"), F.floor(F.col("value") * 100).cast("int").alias("weight"), F.datediff("day", "day0").alias("ts")).distinct()


__all__ = ["EDGE", "session", "supply", "trade"]
