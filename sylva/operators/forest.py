"""Minimum spanning forests of many groups of edges at once.

The forest of a union is the forest of the parts' forests, so every operator here first reduces what
each task has at hand, then what an exchange brings together: a combiner for forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EDGE
from ..storage import release, stored

#: A task reduces its buffer whenever it holds this many rows.
BUFFER_ROWS = 500_000
_COLUMNS = ["key", *EDGE]
_SCHEMA = "key bigint, src int, dest int, weight int, ts int"


def spanning_mask(key: np.ndarray, src: np.ndarray, dest: np.ndarray, weight: np.ndarray, ts: np.ndarray, ordered: bool = False) -> np.ndarray:
    """Which edges are in the minimum spanning forest of their key, in the canonical order.

    Borůvka's rounds over all keys together: ranks are distinct, so each component's least outgoing
    edge is unique and the forest is the one Kruskal's algorithm gives. Exact duplicates: one stays.
    Edges that come in the canonical order already, ``ordered``, are not sorted.
    """
    picked = np.zeros(len(key), bool)
    if not len(key):
        return picked
    order = np.arange(len(key)) if ordered else np.lexsort((dest, src, -ts.astype(np.int64), weight))
    groups = np.unique(key, return_inverse=True)[1].astype(np.int64)[order] << 32
    ends = np.unique(np.concatenate([groups | src[order], groups | dest[order]]), return_inverse=True)[1]
    n = int(ends.max()) + 1
    label = np.arange(n)
    a, b, rank = ends[: len(order)], ends[len(order) :], np.arange(len(order))
    while True:
        la, lb = label[a], label[b]
        out = la != lb
        if not out.any():
            return picked
        a, b, rank, la, lb = a[out], b[out], rank[out], la[out], lb[out]
        place = np.full(n, len(rank))
        np.minimum.at(place, la, np.arange(len(rank)))
        np.minimum.at(place, lb, np.arange(len(rank)))
        roots = np.flatnonzero(place < len(rank))
        best = place[roots]
        picked[order[rank[best]]] = True
        parent = np.arange(n)
        parent[roots] = np.where(la[best] == roots, lb[best], la[best])
        mutual = (parent[parent] == np.arange(n)) & (np.arange(n) < parent)
        parent[mutual] = np.flatnonzero(mutual)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]


def _reduce(table: pa.Table) -> pa.Table:
    return table.filter(pa.array(spanning_mask(*(table.column(c).to_numpy() for c in _COLUMNS))))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce whatever a task has, in bounded memory: what stays above the buffer after reduction goes on as it is."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BUFFER_ROWS:
            left = _reduce(pa.Table.from_batches(held))
            if left.num_rows > BUFFER_ROWS // 2:
                yield from left.to_batches()
                left = left.slice(0, 0)
            held, rows = left.to_batches(), left.num_rows
    if held:
        yield from _reduce(pa.Table.from_batches(held)).to_batches()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce whole keys; rows come sorted by key, and complete keys leave as soon as the buffer is full."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BUFFER_ROWS:
            table = pa.Table.from_batches(held)
            keys = table.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from _reduce(table.slice(0, cut)).to_batches()
                table = table.slice(cut)
            else:
                table = _reduce(table)  # one key fills the buffer: a part of it can be reduced on its own
            held, rows = table.to_batches(), table.num_rows
    if held:
        yield from _reduce(pa.Table.from_batches(held)).to_batches()


def keyed_forest(keyed: DataFrame, key: str) -> DataFrame:
    """The minimum spanning forest of each key's edges: (key, src, dest, weight, ts).

    Each task reduces what it read, so an exchange carries forests; then each key is finished in one
    task, which holds at most two buffers or one key's forest. For keys whose forest alone outgrows a
    task see ``boruvka_forest``.
    """
    rows = keyed.select(F.col(key).cast("bigint").alias("key"), *EDGE).where("src <> dest")
    small = rows.mapInArrow(_combine, _SCHEMA)
    return small.repartition("key").sortWithinPartitions("key").mapInArrow(_finish, _SCHEMA).withColumnRenamed("key", key)


def local_forest(edges: DataFrame) -> DataFrame:
    """The union over all timestamps of the forest of that timestamp: no other edge is in any window's forest."""
    return keyed_forest(edges.withColumn("key", F.col("ts")), "key").select(*EDGE)


def forest(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest of all edges.

    Reduced in tasks first, then by hash of the edge in an eighth as many tasks, until one remains.
    """
    rows = edges.select(F.lit(0).cast("bigint").alias("key"), *EDGE).where("src <> dest").mapInArrow(_combine, _SCHEMA)
    for parts in (64, 8, 1):
        rows = rows.repartition(parts, F.xxhash64(*EDGE)).mapInArrow(_combine, _SCHEMA)
    return rows.repartition(1).mapInArrow(_finish, _SCHEMA).select(*EDGE)


def split_forest(keyed: DataFrame, key: str) -> DataFrame:
    """All edges of each key with ``picked``, whether they are in its forest."""
    found = keyed_forest(keyed, key).withColumn("picked", F.lit(True))
    return keyed.select(key, *EDGE).distinct().join(found, [key, *EDGE], "left").withColumn("picked", F.coalesce("picked", F.lit(False)))


def weight_by_key(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key).agg(F.sum(F.col("weight").cast("bigint")).alias("total_weight"), F.count("*").alias("n_edges"))


def components_by_key(found: DataFrame, keys: DataFrame, key: str, n: int) -> DataFrame:
    """Number of components of each key: all n vertices less the forest's edges; keys without edges have n."""
    counts = found.groupBy(key).agg(F.count("*").alias("k"))
    return keys.select(key).join(counts, key, "left").select(key, (F.lit(n).cast("bigint") - F.coalesce("k", F.lit(0))).alias("n_components"))


def boruvka_forest(keyed: DataFrame, key: str) -> DataFrame:
    """The same forest by joins and aggregations alone, for groups of any size.

    In each round every component takes its least outgoing edge (an aggregation that combines on the
    map side), labels are contracted by pointer jumping, and edges within a component are dropped.
    Rounds at least halve the components. All tables of a round are stored, and deleted when the next
    round has what it needs; edges picked are written once.
    """
    rows = keyed.select(F.col(key).alias("key"), *EDGE).where("src <> dest").distinct()
    live = stored(rows.select("*", F.col("src").alias("a"), F.col("dest").alias("b")), "live")
    rank = F.struct(F.col("weight").alias("w"), (-F.col("ts")).alias("nt"), "src", "dest")
    picked = [keyed.sparkSession.createDataFrame([], live.select("key", *EDGE).schema)]
    while not live.isEmpty():
        ends = live.select("key", F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("o")), F.struct(F.col("b").alias("c"), F.col("a").alias("o")))).alias("e"), rank.alias("r"))
        best = ends.groupBy("key", F.col("e.c").alias("c")).agg(F.min(F.struct("r", F.col("e.o").alias("o"))).alias("m"))
        best = stored(best.select("key", "c", F.col("m.o").alias("o"), "m.r"), "best")
        chosen = best.select("key", F.col("r.src").alias("src"), F.col("r.dest").alias("dest"), F.col("r.w").alias("weight"), (-F.col("r.nt")).alias("ts")).distinct()
        picked.append(stored(chosen, "picked"))
        # each component points to the one its edge leads to; of two that point to each other the smaller is the root
        other = best.select("key", F.col("c").alias("o"), F.col("o").alias("back"))
        up = best.select("key", "c", "o").join(other, ["key", "o"]).select("key", "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("p"))
        done = [best, up := stored(up, "parents")]
        while True:
            again = stored(up.join(up.select("key", F.col("c").alias("p"), F.col("p").alias("pp")), ["key", "p"]).select("key", "c", "p", "pp"), "jump")
            done.append(again)
            if again.where("p <> pp").isEmpty():
                break
            up = again.select("key", "c", F.col("pp").alias("p"))
        label = lambda x: up.select("key", F.col("c").alias(x), F.col("p").alias(f"{x}2"))
        moved = live.join(label("a"), ["key", "a"]).join(label("b"), ["key", "b"]).where("a2 <> b2")
        done.append(live)
        live = stored(moved.select("key", *EDGE, F.col("a2").alias("a"), F.col("b2").alias("b")), "live")
        release(*done)
    return reduce(DataFrame.unionByName, picked).withColumnRenamed("key", key)


def forest_depth(found: DataFrame, key: str) -> DataFrame:
    """(key, max_depth, avg_depth) of each key's trees rooted at their smallest vertex.

    A key's forest is one task, which walks all its trees level by level; its size is that of what
    keyed_forest finishes in one task anyway.
    """

    def run(group: tuple, table: pa.Table) -> pa.Table:
        ends = np.concatenate([table.column(c).to_numpy() for c in ("src", "dest")])
        names, ends = np.unique(ends, return_inverse=True)
        n, half = len(names), len(ends) // 2
        a, b = ends, np.concatenate([ends[half:], ends[:half]])
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        starts = np.searchsorted(a, np.arange(n + 1))
        depth, root = np.full(n, -1), 0
        while root < n:
            if depth[root] < 0:
                depth[root], level, d = 0, np.array([root]), 0
                while len(level):
                    sizes = starts[level + 1] - starts[level]
                    below = b[np.arange(sizes.sum()) + np.repeat(starts[level] - np.cumsum(sizes) + sizes, sizes)]
                    level, d = np.unique(below[depth[below] < 0]), d + 1
                    depth[level] = d
            root += 1
        return pa.table({"key": [group[0].as_py()], "max_depth": pa.array([int(depth.max())], pa.int32()), "avg_depth": [float(depth.mean())]})

    rows = found.select(F.col(key).cast("bigint").alias("key"), "src", "dest")
    return rows.groupBy("key").applyInArrow(run, "key bigint, max_depth int, avg_depth double").withColumnRenamed("key", key)
