"""Graph, window, adjacency and stream files: binary, text and Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import numbered
from ..model import EDGES, adjacency
from ..storage import stored

_EDGE = np.dtype([("src", "<i4"), ("dest", "<i4"), ("weight", "<i4"), ("ts", "<i4")])
_PAIR = np.dtype([("ts", "<i4"), ("te", "<i4")])
_STREAM = np.dtype([("t", "<i4"), ("weight", "<i4"), ("src", "<i4"), ("dest", "<i4")])
_FILE = "path string, modificationTime timestamp, length bigint, content binary"
#: Records that one row of a decoded binary file holds.
CHUNK = 1 << 20


def _columns(records: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(records[n])) for n in records.dtype.names], list(records.dtype.names))


def _decode(content: DataFrame, schema: str, parse) -> DataFrame:
    """Files as rows; a file is one value, so large graphs belong into many files or Parquet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for records in parse(data.as_buffer()):
                    for i in range(0, max(1, len(records)), CHUNK):
                        yield _columns(records[i : i + CHUNK])

    return content.select("content").mapInArrow(run, schema)


def _records(data, kind: np.dtype, header: int, count: int) -> np.ndarray:
    if len(data) < header + count * kind.itemsize:
        raise ValueError(f"the file ends before its {count} records")
    return np.frombuffer(data, kind, count, header)


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)  # a missing path raises


def read_binary_graph(spark: SparkSession, path: str) -> DataFrame:
    """Files of an int32 count and (src, dest, weight, ts) int32 records, little-endian."""
    return _decode(_binary(spark, path), "src int, dest int, weight int, ts int", lambda d: [_records(d, _EDGE, 4, int(np.frombuffer(d, "<i4", 1)[0]))])


def read_binary_windows(spark: SparkSession, path: str) -> DataFrame:
    """(window_id, ts, te) from a uint64 count and int32 pairs; ids are places in the file."""
    found = _decode(_binary(spark, path), "ts int, te int", lambda d: [_records(d, _PAIR, 8, int(np.frombuffer(d, "<u8", 1)[0]))])
    return found.withColumn("window_id", F.monotonically_increasing_id()).select("window_id", "ts", "te")


def read_binary_stream(spark: SparkSession, path: str) -> DataFrame:
    """(t, weight, src, dest) from int32 n, int64 m and m int32 records (t, weight, a, b)."""
    return _events(_binary(spark, path))


def _events(content: DataFrame) -> DataFrame:
    return _decode(content, "t int, weight int, src int, dest int", lambda d: [_records(d, _STREAM, 12, int(np.frombuffer(d, "<i8", 1, 4)[0]))])


def read_binary_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(src, dest, weight) from int32 n, n int32 degrees and (v, w) int32 pairs, vertex by vertex; degrees may exceed n."""

    def parse(d) -> list[np.ndarray]:
        n = int(np.frombuffer(d, "<i4", 1)[0])
        degree = np.frombuffer(d, "<i4", n, 4)
        pairs = _records(d, np.dtype([("v", "<i4"), ("w", "<i4")]), 4 + 4 * n, int(degree.sum()))
        out = np.empty(len(pairs), [("src", "<i4"), ("dest", "<i4"), ("weight", "<i4")])
        out["src"], out["dest"], out["weight"] = np.repeat(np.arange(n), degree), pairs["v"], pairs["w"]
        return [out]

    return _decode(_binary(spark, path), "src int, dest int, weight int", parse)


def binary_graph(records: np.ndarray) -> bytes:
    """A binary graph file of rows (src, dest, weight, ts); for small graphs and tests."""
    return np.int32(len(records)).tobytes() + np.ascontiguousarray(records, "<i4").tobytes()


def _write(rows: DataFrame, folder: str, kind: np.dtype, header) -> None:
    """One file a task, of ``header(records)`` and the records, in a folder that all tasks can reach.

    A task that is run again leaves a file that no manifest names; it is deleted, so that the folder
    holds each row once. Files that were there before stay.
    """
    names, call = list(kind.names), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.column_stack([b.column(i).to_numpy() for i in range(len(names))]) for b in batches]
        if not held:
            return
        made = np.concatenate(held).astype("<i4")
        path = f"{folder.rstrip('/')}/part-{call}-{uuid.uuid4().hex}.bin"
        store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        store.create_dir(name.rpartition("/")[0])
        with store.open_output_stream(name) as out:
            out.write(header(made))
            out.write(made.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    kept = {r["path"].rpartition("/")[2] for r in stored(rows.select(*names).mapInArrow(run, "path string"), "files").collect()}  # a row a file
    store, name = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    store.create_dir(name)
    for found in store.get_file_info(fs.FileSelector(name)):
        if found.base_name not in kept and found.base_name.startswith(f"part-{call}-"):
            store.delete_file(found.path)


def write_binary_graph(edges: DataFrame, folder: str) -> None:
    """Files in the format of read_binary_graph, one a task; a task holds its rows, 16 bytes each."""
    _write(edges, folder, _EDGE, lambda x: np.int32(len(x)).tobytes())


def write_binary_windows(windows: DataFrame, folder: str) -> None:
    """Files in the format of read_binary_windows, one a task."""
    _write(windows, folder, _PAIR, lambda x: np.uint64(len(x)).tobytes())


def write_binary_stream(events: DataFrame, folder: str, n: int) -> None:
    """Files of the events (t, weight, src, dest) in time order in the format of read_binary_stream, one a range of times; n is the number of vertices."""
    dealt = events.repartitionByRange("t", "weight", "src", "dest").sortWithinPartitions("t", "weight", "src", "dest")
    _write(dealt, folder, _STREAM, lambda x: np.int32(n).tobytes() + np.int64(len(x)).tobytes())


def stream_events(spark: SparkSession, folder: str, files_each: int = 1) -> DataFrame:
    """A streaming DataFrame (t, weight, src, dest) of the event files in ``folder`` and those that come, ``files_each`` a micro-batch."""
    source = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", files_each).option("pathGlobFilter", "*.bin").load(folder)
    return _events(source)


def read_text_graph(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``src dest weight ts``; a line that does not fit raises."""
    return spark.read.csv(path, sep=" ", schema=EDGES, mode="FAILFAST")


def write_text_graph(edges: DataFrame, path: str, mode: str = "error") -> None:
    edges.select("src", "dest", "weight", "ts").write.mode(mode).csv(path, sep=" ")


def write_windows(windows: DataFrame, path: str, mode: str = "error") -> None:
    windows.select("window_id", "ts", "te").write.mode(mode).parquet(path)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_adjacency(edges: DataFrame, path: str, multi_edge: bool = False, mode: str = "error") -> None:
    """Both directions of every edge, clustered by vertex, as Parquet."""
    adjacency(edges, multi_edge).repartitionByRange("src").sortWithinPartitions("src", "dest").write.mode(mode).parquet(path)


def write_histogram(histogram: DataFrame, path: str, mode: str = "error") -> None:
    """Lines ``count frequency``."""
    histogram.orderBy(histogram.columns[0]).coalesce(1).write.mode(mode).csv(path, sep=" ")


def tokens(line: Column) -> Column:
    """Maximal runs of digits and dots of a line that starts with a digit; no tokens otherwise."""
    return F.when(line.rlike("^[0-9]"), F.regexp_extract_all(line, F.lit("([0-9.]+)"), 1)).otherwise(F.array().cast("array<string>"))


def token_count(spark: SparkSession, path: str) -> int:
    """The least number of tokens over the first ten lines with two or more."""
    lines = spark.read.text(path).select(F.size(tokens(F.col("value"))).alias("n")).where("n >= 2").limit(10)
    return lines.agg(F.min("n").alias("n")).first()["n"] or 0


def _number(c: Column) -> Column:
    return F.floor(c.cast("double")).cast("int")


def read_loose_edges(spark: SparkSession, path: str, count: int | None = None) -> DataFrame:
    """(src, dest, weight) from the first three tokens of lines with exactly ``count`` tokens; a missing weight is 1."""
    n = token_count(spark, path) if count is None else count
    rows = spark.read.text(path).select(tokens(F.col("value")).alias("x")).where(F.size("x") == n)
    weight = _number(F.get("x", F.lit(2))) if n > 2 else F.lit(1)
    return rows.select(_number(F.get("x", F.lit(0))).alias("src"), _number(F.get("x", F.lit(1))).alias("dest"), weight.alias("weight"))


def read_loose_temporal(spark: SparkSession, path: str, count: int | None = None) -> DataFrame:
    """(src, dest, t) from the first, second and last tokens."""
    n = token_count(spark, path) if count is None else count
    rows = spark.read.text(path).select(tokens(F.col("value")).alias("x")).where(F.size("x") == n)
    return rows.select(_number(F.get("x", F.lit(0))).alias("src"), _number(F.get("x", F.lit(1))).alias("dest"), F.floor(F.get("x", F.lit(n - 1)).cast("double")).cast("bigint").alias("t"))


def read_road(spark: SparkSession, path: str) -> DataFrame:
    """(src, dest, weight) from lines ``a u v w`` with u < v."""
    rows = spark.read.text(path).where(F.col("value").startswith("a")).select(F.regexp_extract_all("value", F.lit("([0-9.]+)"), 1).alias("x")).where(F.size("x") == 3)
    found = rows.select(*(_number(F.get("x", F.lit(i))).alias(c) for i, c in enumerate(("src", "dest", "weight"))))
    return found.where("src < dest")


def unweighted(edges: DataFrame, weights: int = 1 << 25, seed: int = 0) -> DataFrame:
    """(src, dest, weight) of the distinct undirected pairs without loops, with a weight in 1..weights from a hash of the pair."""
    pairs = edges.select(F.least("src", "dest").alias("src"), F.greatest("src", "dest").alias("dest")).where("src <> dest").distinct()
    return pairs.withColumn("weight", (F.pmod(F.xxhash64(F.lit(seed), "src", "dest"), F.lit(weights)) + 1).cast("int"))


def event_stream(temporal: DataFrame, bipartite: bool = False, seed: int = 0, weights: int = 1_000_000) -> DataFrame:
    """(t, weight, src, dest), time-ordered and distinct, from (src, dest, t).

    In a bipartite graph the second id is moved behind the largest first id. Weights, where the
    input has none, come from a hash of the record.
    """
    rows = temporal
    if bipartite:
        first = temporal.agg((F.max("src") + 1).alias("n1"))
        rows = temporal.crossJoin(F.broadcast(first)).withColumn("dest", F.col("dest") + F.col("n1"))  # one row
    rows = rows.select("t", *(["weight"] if "weight" in temporal.columns else []), F.least("src", "dest").alias("src"), F.greatest("src", "dest").alias("dest")).where("src <> dest").distinct()
    if "weight" not in rows.columns:
        rows = rows.withColumn("weight", F.pmod(F.xxhash64(F.lit(seed), "t", "src", "dest"), F.lit(weights)).cast("int"))
    return rows.select("t", "weight", "src", "dest").repartitionByRange("t", "weight", "src", "dest").sortWithinPartitions("t", "weight", "src", "dest")


def dense_times(temporal: DataFrame, t_col: str = "t") -> DataFrame:
    """``ts`` from 0 without gaps in the order of the distinct times."""
    times = numbered(temporal.select(t_col).distinct(), [t_col]).withColumnRenamed("row", "ts")
    return temporal.join(times, t_col).withColumn("ts", F.col("ts").cast("int"))

