"""Exact top-k search by inner product with vector-approximation files (operator 8).

Every component is quantised to one of 256 cells of its dimension, and the cells, a byte a dimension,
are written to files of their own. A scan over these alone gives each candidate a lower and an upper
bound of its score for every query; a candidate whose upper bound is below the k-th lower bound of its
query is out. Exact vectors are then read in the order of the bounds: first those of the k best upper
bounds of each query, then those whose upper bound is no less than the k-th exact score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 1024
CELLS = 256
#: A file of query vectors holds at most this many; a task has one file of them in memory at a time.
QUERY_BLOCK = 4096
#: A task looks at this many rows of cells at a time, and at this many queries of a block.
CHUNK, QUERIES = 32_768, 128
_BOUNDS = "query_id bigint, vec_id bigint, lower double, upper double"


def _by_length(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places in the batch of the vectors of that length, and their scaled whole components."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    starts = np.cumsum(sizes) - sizes
    out = {}
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        out[int(n)] = rows, flat[starts[rows][:, None] + np.arange(n)]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row the whole inner products. Where doubles might round, in 64-bit integers (components beyond 2**62 are no input)."""
    most = max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a * b).sum(1).astype(np.int64)
    return (a.astype(np.int64) * b.astype(np.int64)).sum(1)


class Cells:
    """The cells of each dimension between the least and greatest components of all vectors."""

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        self.low, self.width = low, np.maximum(high - low, 1e-9) / CELLS

    def codes(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.low) / self.width, 0, CELLS - 1).astype(np.uint8)

    def bounds(self, queries: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores of the cells' middles, a row a query, and how far a score can lie from them.

        The product is of single floats; its rounding, at most n times 2**-24 of the sum of the
        products' sizes, is in the radius.
        """
        scaled = queries * self.width
        middle = (scaled.astype(np.float32) @ codes.T.astype(np.float32)).astype(np.float64) + (queries @ (self.low + self.width / 2))[:, None]
        size = np.abs(scaled).sum(1)
        rounding = (queries.shape[1] + 2) * 2.0**-23 * CELLS * size + 1e-9 * (np.abs(queries) @ (np.abs(self.low) + CELLS * self.width)) + 1e-6
        return middle, size / 2 * (1 + 1e-6) + rounding


def survivors(middle: np.ndarray, radius: np.ndarray, own: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) places whose upper bound reaches the k-th lower bound of the query.

    ``own`` marks what is no candidate of the query, ``first`` has one place for each distinct id, as
    k lower bounds count only if they are of different ids.
    """
    lower = np.where(own, -np.inf, middle - radius[:, None])[:, first]
    floor = np.full(len(middle), -np.inf)
    if lower.shape[1] > k:
        floor = np.partition(lower, -k, axis=1)[:, -k]
    return np.nonzero((middle + radius[:, None] >= floor[:, None]) & ~own)


def search(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by ``every`` the k best others.

    Vectors that are null or have a null or non-finite component, and rows with a null id, take no
    part; empty vectors score 0 with each other; vectors of different lengths are not compared.
    Ties go to the smaller id. Of rows with one id, a query is the least vector, and a candidate
    counts once with its best score. Other columns are not read. An empty table gives an empty table.
    """
    rows = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].alias("vector"))
    real = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & real)
    double = F.col("vector").cast("array<double>").alias("vector")
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", double).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries = stored(queries, "queries", maxRecordsPerFile=QUERY_BLOCK)
    rows = _few_copies(rows, k).select("vec_id", double)
    cells = _ranges(rows)
    found = scan(approximation(rows, cells), queries, cells, k)

    def first(pairs: DataFrame, by: str) -> DataFrame:
        """The k best pairs of each query; tasks drop what is beyond them before the exchange."""
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "vec_id"))
        return pairs.withColumn("rank", place).where(F.col("rank") <= k)

    def floor(pairs: DataFrame, by: str) -> DataFrame:
        """The least of k values; queries with fewer have none."""
        return pairs.groupBy("query_id").agg(F.min(by).alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", "floor")

    best = stored(found.groupBy("query_id", "vec_id").agg(F.max("lower").alias("lower"), F.max("upper").alias("upper")), "bounds")
    left = best.join(floor(first(best, "lower"), "lower"), "query_id", "left").where("floor is null or upper >= floor")
    left = stored(left.select("query_id", "vec_id", "upper"), "left")
    begin = first(left, "upper").select("query_id", "vec_id")
    scored = stored(exact(begin, rows, queries), "exact")
    rest = left.join(floor(scored, "score"), "query_id", "left").where("floor is null or upper >= floor")
    rest = rest.select("query_id", "vec_id").join(begin, ["query_id", "vec_id"], "left_anti")
    both = scored.unionByName(exact(rest, rows, queries))
    return first(both, "score").select("query_id", "rank", "vec_id", "score")


def _few_copies(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with the k + 1 smallest ids of each vector, as a stored table.

    Equal vectors have equal scores and ties go to smaller ids, so no other copy can be among a
    query's k best, not even if one of these is the query. A task drops copies beyond that before the
    exchange, so a vector that a third of all rows have costs a few rows a task.
    """
    same = F.xxhash64("vector").alias("g"), F.xxhash64(F.lit(1), "vector").alias("h")
    nth = F.dense_rank().over(Window.partitionBy("g", "h").orderBy("vec_id"))
    few = rows.select("*", *same).withColumn("nth", nth).where(F.col("nth") <= k + 1)
    return stored(few.dropDuplicates(["g", "h", "vec_id"]).select("vec_id", "vector"), "vectors")


def _ranges(rows: DataFrame) -> dict[int, Cells]:
    """The least and greatest component of each dimension over all vectors: one row a dimension comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, (_, x) in _by_length(batch.column(0)).items():
                low, high = (x.min(0), x.max(0)) if n else (np.zeros(1), np.zeros(1))
                m = max(1, n)
                yield pa.RecordBatch.from_arrays([pa.array([n] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array(low), pa.array(high)], ["n", "at", "low", "high"])

    ranges = rows.select("vector").mapInArrow(run, "n int, at int, low double, high double")
    found = ranges.groupBy("n", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("n", "at").collect()
    by: dict[int, list] = {}
    for r in found:
        by.setdefault(r["n"], []).append((r["low"], r["high"]))
    return {n: Cells(*(np.array(x)[:n] for x in zip(*v, strict=True))) for n, v in by.items()}


def approximation(rows: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """The approximation file: (n, ids, codes), up to CHUNK vectors of n components a row, ids and cells as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(n: int) -> pa.RecordBatch:
            ids, codes = (np.concatenate(x) for x in zip(*held.pop(n), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([codes.tobytes()])], ["n", "ids", "codes"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for n, (at, x) in _by_length(batch.column(1)).items():
                for a in range(0, len(at), CHUNK):
                    held.setdefault(n, []).append((ids[at[a : a + CHUNK]], cells[n].codes(x[a : a + CHUNK])))
                    if sum(len(i) for i, _ in held[n]) >= CHUNK // 2:
                        yield flush(n)
        for n in list(held):
            yield flush(n)

    return stored(rows.mapInArrow(run, "n int, ids binary, codes binary"), "cells")


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def scan(approximated: DataFrame, queries: DataFrame, cells: dict[int, Cells], k: int) -> DataFrame:
    """(query_id, vec_id, lower, upper) of the candidates that their chunk's bounds don't rule out.

    Every row of cells is read once and meets all queries, file by file of their stored table, so a
    task's memory does not grow with the queries.
    """
    paths = queries.inputFiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: tuple[str, dict] = ("", {})
        for batch in batches:
            for n, ids, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(ids, "<i8")
                codes = np.frombuffer(codes, np.uint8).reshape(len(ids), n)
                first = np.unique(ids, return_index=True)[1]
                for path in paths:
                    if loaded[0] != path:
                        store, name = _filesystem(path)
                        table = pq.read_table(name, filesystem=store).combine_chunks().to_batches()[0]
                        loaded = path, {m: (table.column(0).to_numpy()[at], x) for m, (at, x) in _by_length(table.column(1)).items()}
                    numbers, asked = loaded[1].get(n, (np.empty(0, np.int64), np.empty((0, n))))
                    for a in range(0, len(numbers), QUERIES):
                        of = numbers[a : a + QUERIES]
                        middle, radius = cells[n].bounds(asked[a : a + QUERIES], codes)
                        q, c = survivors(middle, radius, of[:, None] == ids[None, :], first, k)
                        near = middle[q, c]
                        yield pa.RecordBatch.from_arrays([pa.array(of[q]), pa.array(ids[c]), pa.array(near - radius[q]), pa.array(near + radius[q])], ["query_id", "vec_id", "lower", "upper"])

    return approximated.mapInArrow(run, _BOUNDS)


def exact(pairs: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) of the pairs; of the exact vectors only those of their candidates leave the scan.

    Whether the ids are broadcast is Spark's choice by the size of the table that they come from.
    """
    read = rows.join(pairs.select("vec_id").distinct(), "vec_id", "left_semi")
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    both = pairs.select("query_id", "vec_id").join(read, "vec_id").join(asked, "query_id").where(F.size("query") == F.size("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, (at, x) in _by_length(batch.column(2)).items():
                place = pa.array(at)
                score = _products(x, _by_length(batch.column(3).take(place))[n][1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), pa.array(score)], ["query_id", "vec_id", "score"])

    scores = both.select("query_id", "vec_id", "vector", "query").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    return scores.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
