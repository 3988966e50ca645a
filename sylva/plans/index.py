"""Indexes on disk: one folder with a table for each cover.

Tables are partitioned by what queries join on: rectangles by a range of t, nodes and cells by level
and a range of positions. A query joins on these columns too, so that the windows it is asked for
prune the folders that it reads (dynamic partition pruning).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import rectangle_sort
from ..operators import cover
from ..operators.staircase import rectangles
from .query import Index, node_part, t_part

TABLES = ("staircase", "rects", "rect_nodes", "rect_start_nodes", "rect_cells")


def save(steps: DataFrame, total: int, folder: str, files: int = 8) -> None:
    """Write the staircase and all covers below ``folder``."""
    spark = steps.sparkSession
    folder = folder.rstrip("/")
    span = max(1, total // files)
    steps.withColumn("t_part", t_part("t", span)).repartitionByRange(files, "t").write.mode("overwrite").partitionBy("t_part").parquet(f"{folder}/staircase")
    rects = rectangles(spark.read.parquet(f"{folder}/staircase").drop("t_part"))
    rectangle_sort(rects.withColumn("t_part", t_part("t", span)).repartitionByRange(files, "t")).write.mode("overwrite").partitionBy("t_part").parquet(f"{folder}/rects")
    rects = spark.read.parquet(f"{folder}/rects").drop("t_part")
    for name, table, at, then in (
        ("rect_nodes", cover.end_nodes(rects, total), "pos", ["s", "t"]),
        ("rect_start_nodes", cover.start_nodes(rects, total), "pos", ["t1", "t2"]),
        ("rect_cells", cover.cells(rects, total), "cx", ["cy"]),
    ):
        dealt = table.withColumn("part", node_part(at, total)).repartitionByRange(files, "level", "part", at)
        dealt.sortWithinPartitions("level", "part", at, *then).write.mode("overwrite").partitionBy("level", "part").parquet(f"{folder}/{name}")
    spark.createDataFrame([(json.dumps({"t_count": total, "t_span": span}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")


def load(spark: SparkSession, folder: str) -> Index:
    """The index in ``folder``; a missing one raises."""
    folder = folder.rstrip("/")
    meta = json.loads(spark.read.text(f"{folder}/meta").first()["value"])
    read = {n: spark.read.parquet(f"{folder}/{n}") for n in TABLES[1:]}
    return Index(read["rects"], meta["t_count"], read["rect_nodes"], read["rect_start_nodes"], read["rect_cells"], meta["t_span"])


def load_staircase(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/staircase").drop("t_part")


def sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(name, n_files, n_bytes) of each table of the index; lengths alone are read."""
    found = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{folder.rstrip('/')}/{n}").select(F.lit(n).alias("name"), "length") for n in TABLES]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("name").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))
