"""Expiry staircases: for every edge the window starts at which it leaves the forest, as the window's end grows.

For a window end te and an edge e of time t <= te, s(e, te) is the largest start at which e is not in
the forest of [start, te], -1 if there is none. It is the lesser of t and the largest, over paths of
edges before e, of the path's least timestamp; sweeping edges in the canonical order over a forest
that keeps the newest edges gives it for one te without any other te.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import EDGE, OPEN, t_count
from ..storage import stored
from .forest import local_forest, spanning_mask

_STEP = "src int, dest int, weight int, t int, s int, te int"


class NewestForest:
    """A forest in which each inserted edge replaces the oldest edge of the path between its ends, if that is older.

    Trees are kept by parent pointers; linking turns around the smaller tree's path to its root.
    """

    def __init__(self, n: int) -> None:
        self.parent, self.age, self.size = [-1] * n, [0] * n, [1] * n
        self.stamp, self.mark = [0] * n, 0

    def insert(self, u: int, v: int, t: int) -> int:
        """The least timestamp on the path between u and v, -1 without one; the edge goes in if it is newer."""
        parent, age = self.parent, self.age
        self.mark += 1
        stamp, mark = self.stamp, self.mark
        a = u
        while a >= 0:
            stamp[a] = mark
            a = parent[a]
        b, least, at = v, OPEN, -1
        while stamp[b] != mark:
            if age[b] < least and parent[b] >= 0:
                least, at = age[b], b
            if parent[b] < 0:
                self._link(u, v, t)
                return -1
            b = parent[b]
        a = u
        while a != b:
            if age[a] < least:
                least, at = age[a], a
            a = parent[a]
        if least < t:
            self._cut(at)
            self._link(u, v, t)
        return least

    def _root(self, a: int) -> int:
        while self.parent[a] >= 0:
            a = self.parent[a]
        return a

    def _cut(self, a: int) -> None:
        below, up = self.size[a], self.parent[a]
        self.parent[a] = -1
        while up >= 0:
            self.size[up] -= below
            up = self.parent[up]

    def _link(self, u: int, v: int, t: int) -> None:
        if self.size[self._root(u)] > self.size[self._root(v)]:
            u, v = v, u
        # turn the path from u to its root around
        path = [u]
        while self.parent[path[-1]] >= 0:
            path.append(self.parent[path[-1]])
        for a, b in zip(reversed(path[:-1]), reversed(path[1:]), strict=True):
            self.parent[b], self.age[b] = a, self.age[a]
            self.size[b] -= self.size[a]
            self.size[a] += self.size[b]
        self.parent[u], self.age[u] = v, t
        while v >= 0:
            self.size[v] += self.size[u]
            v = self.parent[v]


def expiry(edges: np.ndarray) -> np.ndarray:
    """s of each edge, rows (src, dest, weight, t), for the window end that is the largest t among them or later."""
    order = np.lexsort((edges[:, 1], edges[:, 0], -edges[:, 3], edges[:, 2]))
    ends = np.unique(edges[:, :2], return_inverse=True)[1].reshape(-1, 2)
    forest, s = NewestForest(int(ends.max()) + 1 if len(ends) else 0), np.empty(len(edges), np.int64)
    for i, u, v, t in zip(order.tolist(), ends[order, 0].tolist(), ends[order, 1].tolist(), edges[order, 3].tolist(), strict=True):
        s[i] = t if u == v else min(t, forest.insert(u, v, t))
    return s


def scan(edges: np.ndarray, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(te, edges, s) for te in first..last over candidates of any t <= last: the edges still alive and what became of them.

    The first te looks at every candidate before it; later ones at those with s < t, since s never falls.
    One sweep gives s for a te as a whole, so there is no loop over window starts that could end early
    when all edges of te are out; that rule's saving, not to look at dead edges, is the filter on s < t.
    """
    order = np.argsort(edges[:, 3], kind="stable")
    edges = edges[order]
    bounds = np.searchsorted(edges[:, 3], np.arange(first, last + 2))
    alive = edges[: bounds[0]]
    for k, te in enumerate(range(first, last + 1)):
        live = np.concatenate([alive, edges[bounds[k] : bounds[k + 1]]])
        s = expiry(live)
        yield te, live, s
        alive = live[s < live[:, 3]]


def staircase(edges: DataFrame, blocks: int = 8, reduced: bool = False, t_total: int | None = None) -> DataFrame:
    """(src, dest, weight, t, s, te_from): for every edge of the local forest the ends te_from at which its s grows to s.

    The te axis is cut into blocks that know nothing of each other; a block gets the candidates up to
    its end, so a task holds one local forest. Within a block a row is made when s changes, and after
    the exchange rows that repeat the step before them are dropped.
    """
    base = edges if reduced else local_forest(edges)
    base = stored(base.select(*EDGE), "candidates")
    total = t_total if t_total is not None else t_count(base)
    length = max(1, -(-total // max(1, blocks)))
    last_block = max(0, (total - 1) // length)
    dealt = base.withColumn("block", F.explode(F.sequence(F.floor(F.col("ts") / length).cast("int"), F.lit(last_block))))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        rows = np.stack([table.column(c).to_numpy().astype(np.int64) for c in EDGE], axis=1)
        seen: dict[tuple, int] = {}
        out = []
        for te, live, s in scan(rows, block * length, min(total, (block + 1) * length) - 1):
            for edge, value in zip(map(tuple, live.tolist()), s.tolist(), strict=True):
                if seen.get(edge) != value:
                    seen[edge] = value
                    out.append((*edge, value, te))
        columns = np.array(out, np.int32).reshape(-1, 6).T
        return pa.table([pa.array(x) for x in columns], names=["src", "dest", "weight", "t", "s", "te"])

    steps = dealt.groupBy("block").applyInArrow(run, _STEP)
    before = F.lag("s").over(Window.partitionBy("src", "dest", "weight", "t").orderBy("te"))
    return steps.withColumn("before", before).where("before is null or s > before").select("src", "dest", "weight", "t", "s", F.col("te").alias("te_from"))


def records(steps: DataFrame) -> DataFrame:
    """One row an edge with its staircase as an array of (s, te_from)."""
    return steps.groupBy("src", "dest", "weight", "t").agg(F.sort_array(F.collect_list(F.struct("te_from", "s"))).alias("r")).select("src", "dest", "weight", "t", F.transform("r", lambda x: F.struct(x["s"].alias("s"), x["te_from"].alias("te_from"))).alias("record"))


def rectangles(steps: DataFrame, keep_empty: bool = False) -> DataFrame:
    """(src, dest, weight, t, s, t1, t2): the edge is in the forest of (ts, te) iff s < ts <= t and t1 <= te < t2 for one of them."""
    follow = F.lead("te_from", 1, OPEN).over(Window.partitionBy("src", "dest", "weight", "t").orderBy("te_from"))
    rects = steps.select("src", "dest", "weight", "t", "s", F.col("te_from").alias("t1"), follow.alias("t2"))
    return rects if keep_empty else rects.where("s < t")


def mean_lifetime(steps: DataFrame, total: int) -> DataFrame:
    """One row: the mean over edges of how many timestamps pass until the edge is dead, or until the last."""
    last = steps.groupBy("src", "dest", "weight", "t").agg(F.max(F.struct("te_from", "s")).alias("x"))
    life = F.when(F.col("x.s") == F.col("t"), F.col("x.te_from") - F.col("t")).otherwise(F.lit(total) - F.col("t"))
    return last.agg(F.avg(life).alias("mean_lifetime"))


def mean_t_per_s(rects: DataFrame) -> DataFrame:
    """One row: the mean number of distinct t for each (t1, t2, s)."""
    return rects.groupBy("t1", "t2", "s").agg(F.count_distinct("t").alias("k")).agg(F.avg("k").alias("mean_t_per_s"))
