"""A forest under insertions and deletions, and replays of event streams over it."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.forest import forest, keyed_forest, spanning_mask
from ..storage import stored

#: Result codes: the edge does not fit the graph; two trees joined, or a tree fell apart; the forest is the same; one edge replaced another.
INVALID, STRUCTURAL, UNCHANGED, REPLACED = -1, 0, 1, 2

#: thin() cuts time into at most this many spans, and fewer where their forests together would have more rows than the second figure.
SPANS, FOREST_ROWS = 200, 100_000
#: A window covers about this many spans: each of them is a test of an edge.
WINDOW_SPANS = 8

Edge = tuple[int, int, int, int]


def order(e: Edge) -> tuple[int, int, int, int]:
    """The canonical order of (src, dest, weight, ts)."""
    return e[2], -e[3], e[0], e[1]


class DynamicForest:
    """The minimum spanning forest of a changing set of edges (src, dest, weight, ts) over n vertices.

    The forest's edges are kept by vertex, and the others, by vertex too, in the canonical order. An
    insertion looks at the path between the edge's ends. A deletion of a forest edge goes over the
    vertices of the smaller side, and over a vertex's other edges only up to the best replacement
    known, so what it looks at are edges that stay within the side and are lighter than that.
    ``work`` counts operations, vertices visited and edges looked at as replacements.
    """

    def __init__(self, n: int) -> None:
        self.n = n
        self.edges: set[Edge] = set()
        self.rest: dict[int, list[tuple[tuple[int, int, int, int], Edge]]] = defaultdict(list)
        self.tree: dict[int, set[Edge]] = defaultdict(set)
        self.size = 0
        self.work: Counter[str] = Counter()

    @classmethod
    def of(cls, n: int, edges: list[Edge]) -> DynamicForest:
        """The forest of a graph at hand, found as a whole; loops, repeated edges and ids beyond n are left out."""
        made = cls(n)
        rows = np.array(sorted({e for e in edges if made._valid(e)}, key=order), np.int64).reshape(-1, 4)
        picked = spanning_mask(np.zeros(len(rows), np.int64), *rows.T, ordered=True)
        for e, yes in zip(map(tuple, rows.tolist()), picked.tolist(), strict=True):
            made.edges.add(e)
            if yes:
                made._link(e)
            else:
                made._put_aside(e)
        return made

    def _put_aside(self, e: Edge) -> None:
        for a in e[:2]:
            insort(self.rest[a], (order(e), e))

    def _take_back(self, e: Edge) -> None:
        for a in e[:2]:
            at = bisect_left(self.rest[a], (order(e), e))
            del self.rest[a][at]

    def _valid(self, e: Edge) -> bool:
        return e[0] != e[1] and 0 <= e[0] < self.n and 0 <= e[1] < self.n

    def _path(self, u: int, v: int) -> list[Edge] | None:
        """The forest's edges between two vertices: both sides are searched in turn, so the cost is the smaller side's."""
        came: tuple[dict[int, Edge | None], ...] = ({u: None}, {v: None})
        fronts = [[u], [v]]
        while fronts[0] and fronts[1]:
            k = 0 if len(came[0]) <= len(came[1]) else 1
            follow = []
            for a in fronts[k]:
                for e in self.tree[a]:
                    b = e[1] if e[0] == a else e[0]
                    if b in came[k]:
                        continue
                    came[k][b] = e
                    self.work["visited"] += 1
                    if b in came[1 - k]:
                        return self._back(came[0], b) + self._back(came[1], b)
                    follow.append(b)
            fronts[k] = follow
        return None

    @staticmethod
    def _back(came: dict[int, Edge | None], at: int) -> list[Edge]:
        out = []
        while (e := came[at]) is not None:
            out.append(e)
            at = e[0] if e[1] == at else e[1]
        return out

    def _link(self, e: Edge) -> None:
        self.tree[e[0]].add(e)
        self.tree[e[1]].add(e)
        self.size += 1

    def _cut(self, e: Edge) -> None:
        self.tree[e[0]].discard(e)
        self.tree[e[1]].discard(e)
        self.size -= 1

    def insert(self, e: Edge) -> tuple[int, Edge | None]:
        """The code, and the forest edge that had to go."""
        if not self._valid(e) or e in self.edges:
            return INVALID, None
        self.work["inserted"] += 1
        path = self._path(e[0], e[1])
        self.edges.add(e)
        if path is None:
            self._link(e)
            return STRUCTURAL, None
        worst = max(path, key=order)
        if order(worst) < order(e):
            self._put_aside(e)
            return UNCHANGED, None
        self._cut(worst)
        self._put_aside(worst)
        self._link(e)
        return REPLACED, worst

    def delete(self, e: Edge) -> tuple[int, Edge | None]:
        """The code, and the edge that took its place."""
        if e not in self.edges:
            return INVALID, None
        self.work["deleted"] += 1
        self.edges.discard(e)
        if e not in self.tree[e[0]]:
            self._take_back(e)
            return UNCHANGED, None
        self._cut(e)
        side = self._smaller_side(e[0], e[1])
        best: tuple | None = None
        for a in side:
            for x in self.rest[a]:
                if best and x >= best:
                    break
                self.work["looked at"] += 1
                if (x[1][0] in side) != (x[1][1] in side):
                    best = x
                    break
        if not best:
            return STRUCTURAL, None
        self._take_back(best[1])
        self._link(best[1])
        return REPLACED, best[1]

    def _smaller_side(self, u: int, v: int) -> set[int]:
        sides, fronts = ({u}, {v}), [[u], [v]]
        while True:
            k = 0 if len(sides[0]) <= len(sides[1]) else 1
            if not fronts[k]:
                return sides[k]
            follow = []
            for a in fronts[k]:
                for e in self.tree[a]:
                    b = e[1] if e[0] == a else e[0]
                    if b not in sides[k]:
                        self.work["visited"] += 1
                        sides[k].add(b)
                        follow.append(b)
            fronts[k] = follow

    def forest(self) -> list[Edge]:
        return sorted({e for es in self.tree.values() for e in es}, key=order)

    def weight(self) -> int:
        return sum(e[2] for e in self.forest())

    def components(self) -> int:
        return self.n - self.size

    def __str__(self) -> str:
        """The forest's edges, one a line, in the canonical order."""
        return "\n".join("{} {} {} {}".format(*e) for e in self.forest())

    def is_below(self, v: int, ancestor: int, root: int) -> bool:
        """Whether ``ancestor`` is on the way from v to the root."""
        if v == ancestor or v == root:
            return v == ancestor
        path = self._path(v, root)
        return path is not None and any(ancestor in e[:2] for e in path)


_OUT = "graph_id bigint, seq bigint, op string, code int, src int, dest int, weight int, ts int"


def replay(operations: DataFrame, n: int) -> DataFrame:
    """Apply operations (graph_id, seq, op insert|delete, src, dest, weight, ts) of each graph in the order of seq.

    Updates of one graph depend on each other, so a graph is one task; different graphs run apart. The
    task reads its operations in order, a batch at a time, and holds the graph's live edges.
    Returns each operation's code, with src, dest, weight and ts of the edge removed or put in its place, if any.
    """

    def run(batches):
        live: tuple[int | None, DynamicForest] = (None, DynamicForest(n))
        for batch in batches:
            graphs, ops = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            edges = list(zip(*(batch.column(k).to_pylist() for k in (3, 4, 5, 6)), strict=True))
            codes, others = [], []
            for graph, op, e in zip(graphs, ops, edges, strict=True):
                if graph != live[0]:
                    live = (graph, DynamicForest(n))
                code, other = live[1].insert(e) if op == "insert" else live[1].delete(e)
                codes.append(code)
                others.append(other or (None,) * 4)
            columns = [pa.array(x, pa.int32()) for x in (codes, *zip(*others, strict=True))]
            if codes:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], ["graph_id", "seq", "op", "code", "src", "dest", "weight", "ts"])

    rows = operations.select("graph_id", "seq", "op", "src", "dest", "weight", "ts")
    return rows.repartition("graph_id").sortWithinPartitions("graph_id", "seq").mapInArrow(run, _OUT)


def code_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("op", "code").agg(F.count("*").alias("n"))


def sliding_operations(events: DataFrame, width: int, drain: bool = False) -> DataFrame:
    """The operations of a window that slides over (seq, t, src, dest, weight): each event goes in, then events older than ``width`` go out.

    An event leaves right after the first event later than t + width; both ends of [now - width, now]
    stay. With ``drain`` those left at the end go out too. In descending order of time the first event
    later than that is a running minimum, so the work is that of a sort.
    """
    by_time = Window.partitionBy("graph_id").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, -(width + 1))
    rows = events.withColumn("out_seq", F.min("seq").over(by_time))
    last = F.max("seq").over(Window.partitionBy("graph_id"))
    out = rows.withColumn("last", last)
    gone = out.where("out_seq is not null" if not drain else "true").select("graph_id", F.coalesce("out_seq", "last").alias("at"), F.lit("delete").alias("op"), "seq", "src", "dest", "weight", "t")
    come = rows.select("graph_id", F.col("seq").alias("at"), F.lit("insert").alias("op"), "seq", "src", "dest", "weight", "t")
    ranked = come.unionByName(gone)
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy("at", F.desc("op"), "seq"))
    return ranked.select("graph_id", place.cast("bigint").alias("seq"), "op", "src", "dest", "weight", F.col("t").alias("ts"))


class _Links:
    """Whether edges lighter than a given one join its ends, in many forests at once: trees of unions by size, whose links bear the edge's rank."""

    def __init__(self, size: int) -> None:
        self.up, self.rank = np.arange(size), np.full(size, np.iinfo(np.int64).max)

    @classmethod
    def of(cls, size: int, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> _Links:
        """From forest edges between the vertices of all forests, in ascending order of rank."""
        made = cls(size)
        up, held = made.up.tolist(), [1] * size
        for x, y, r in zip(a.tolist(), b.tolist(), rank.tolist(), strict=True):
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if held[x] > held[y]:
                x, y = y, x
            up[x], made.rank[x] = y, r
            held[y] += held[x]
        made.up = np.array(up, np.int64)
        return made

    def _top(self, x: np.ndarray, rank: np.ndarray) -> np.ndarray:
        while (lighter := self.rank[x] < rank).any():
            x = np.where(lighter, self.up[x], x)
        return x

    def joined(self, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return self._top(a, rank) == self._top(b, rank)


def _rank(weight: np.ndarray, ts: np.ndarray) -> np.ndarray:
    """A number that is less only if the edge comes earlier in the canonical order; edges that differ in their ends alone have the same."""
    return weight.astype(np.int64) * (1 << 32) - ts


_THIN = "graph_id bigint, ts int, src int, dest int, weight int, idle boolean, gone boolean, n bigint"
_THIN_NAMES = ["graph_id", "ts", "src", "dest", "weight", "idle", "gone", "n"]


def thin(edges: DataFrame, width: int, n: int, spans: int = SPANS) -> DataFrame:
    """The edges (graph_id, src, dest, weight, ts) of a stream in the order of ts, weight, src, dest, without most of those that are in no forest while a window of ``width`` slides over it.

    Such edges change nothing: every code of theirs is UNCHANGED, and the forests of the others are
    those of all. They are returned as counts ``n`` by graph, time and whether they slide out, with
    ``idle``; the rest are rows with n = 1. Time is cut into spans. The edges that are in the window
    from a span's start to its end are reduced to their forest, and an edge whose ends lighter edges
    of it join can't be in any forest within that span; if this is so in all spans of its life, it
    is idle. All of this is by tasks that each have a part of the edges; the forests of the spans,
    a few thousand edges, go to all of them. The first edge of each timestamp stays, as evictions
    follow it. Edges must be distinct; loops and ids beyond n stay. Where the graphs and vertices are
    too many for two spans, or a window is all there is, every edge stays.
    """
    spark = edges.sparkSession
    edges = edges.select("graph_id", "src", "dest", "weight", "ts")
    firsts = stored(edges.groupBy("graph_id", "ts").agg(F.min(F.struct("weight", "src", "dest")).alias("first")), "firsts")
    ends = firsts.agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count_distinct("graph_id").alias("graphs")).first()
    extent = 0 if ends["a"] is None else ends["b"] - ends["a"] + 1
    most = min(spans, FOREST_ROWS // (max(1, n) * max(1, ends["graphs"])))
    size = max(1, -(-extent // max(1, most)), -(-width // WINDOW_SPANS))
    k = -(-extent // size)
    if most < 2 or k < 2:
        return edges.select("graph_id", "ts", "src", "dest", "weight", F.lit(False).alias("idle"), F.lit(None).cast("boolean").alias("gone"), F.lit(1).cast("bigint").alias("n"))

    start = ends["a"]
    span = lambda t: F.floor((t - start) / size).cast("int")
    latest = {(r["graph_id"], r["span"]): r["last"] for r in firsts.groupBy("graph_id", span(F.col("ts")).alias("span")).agg(F.max("ts").alias("last")).collect()}
    graphs, calendar = sorted({g for g, _ in latest}), []
    for i, g in enumerate(graphs):
        after = k
        for at in range(k, -1, -1):
            calendar.append((g, i, at, latest.get((g, at)), after))
            after = at if (g, at) in latest else after
    calendar = F.broadcast(spark.createDataFrame(calendar, "graph_id bigint, g int, until int, last int, after int"))
    # an edge goes out in the span of the first event later than ts + width; it stays beyond the last span if there is none
    late = F.col("ts").cast("bigint") + width
    lives = edges.withColumn("until", F.least(F.lit(k), span(late + 1))).join(calendar, ["graph_id", "until"])
    lives = lives.select("graph_id", *("src", "dest", "weight", "ts"), "g", span(F.col("ts")).alias("a"), F.when(F.col("last") > late, F.col("until")).otherwise(F.col("after")).alias("z"))
    valid = F.col("src").between(0, n - 1) & F.col("dest").between(0, n - 1)
    base = k + 1
    keyed = lives.where(valid & (F.col("z") - F.col("a") > 1)).withColumn("key", (F.col("g").cast("bigint") * base + F.col("a")) * base + F.col("z"))
    g, a, z = (F.floor(x).cast("int") for x in (F.col("key") / (base * base), F.col("key") / base % base, F.col("key") % base))
    inner = keyed_forest(keyed, "key").withColumn("span", F.explode(F.sequence(a + 1, z - 1))).withColumn("key", g.cast("bigint") * base + F.col("span"))
    held = keyed_forest(inner, "key").toArrow()
    slot, src, dest, weight, ts = (held.column(c).to_numpy().astype(np.int64) for c in ("key", "src", "dest", "weight", "ts"))
    rank = _rank(weight, ts)
    order_ = np.argsort(rank, kind="stable")
    links = _Links.of(len(graphs) * base * n, (slot * n + src)[order_], (slot * n + dest)[order_], rank[order_])
    shared = spark.sparkContext.broadcast((links.up, links.rank))

    def run(batches):
        links = _Links(0)
        links.up, links.rank = shared.value
        for batch in batches:
            graph, src, dest, weight, ts, g, a, z, first = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            idle = ~first & (src != dest) & (src >= 0) & (src < n) & (dest >= 0) & (dest < n)
            rank, gone = _rank(weight, ts), z < k
            at, last = a.astype(np.int64), np.minimum(z, k - 1)
            open_ = np.flatnonzero(idle)
            while len(open_):
                slot = (g[open_].astype(np.int64) * base + at[open_]) * n
                here = links.joined(slot + src[open_], slot + dest[open_], rank[open_])
                idle[open_[~here]] = False
                open_ = open_[here]
                at[open_] += 1
                open_ = open_[at[open_] <= last[open_]]
            rows, stay = np.flatnonzero(idle), ~idle
            ints = [pa.array(x[stay].astype(np.int32)) for x in (ts, src, dest, weight)]
            yield pa.RecordBatch.from_arrays([pa.array(graph[stay]), *ints, pa.array(np.zeros(stay.sum(), bool)), pa.array(gone[stay]), pa.array(np.ones(stay.sum(), np.int64))], _THIN_NAMES)
            if len(rows):
                kinds, counts = np.unique(np.stack([graph[rows], ts[rows].astype(np.int64), gone[rows].astype(np.int64)]), axis=1, return_counts=True)
                none = pa.nulls(len(counts), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(kinds[0]), pa.array(kinds[1].astype(np.int32)), none, none, none, pa.array(np.ones(len(counts), bool)), pa.array(kinds[2].astype(bool)), pa.array(counts)], _THIN_NAMES)

    first = F.struct("weight", "src", "dest") == F.col("first")
    rows = lives.join(firsts, ["graph_id", "ts"]).select(F.col("graph_id").cast("bigint").alias("graph_id"), "src", "dest", "weight", "ts", "g", "a", "z", first.alias("first"))
    return rows.mapInArrow(run, _THIN)


def events_of(thinned: DataFrame) -> DataFrame:
    """The edges that thin() left as events (graph_id, seq, t, src, dest, weight) for sliding_operations()."""
    seq = F.row_number().over(Window.partitionBy("graph_id").orderBy("ts", "weight", "src", "dest")).cast("bigint")
    return thinned.where("not idle").select("graph_id", seq.alias("seq"), F.col("ts").alias("t"), "src", "dest", "weight")


def idle_counts(thinned: DataFrame) -> DataFrame:
    """(op, code, n) of the edges that thin() took out."""
    idle = thinned.where("idle")
    come = idle.select(F.lit("insert").alias("op"), "n")
    gone = idle.where("gone").select(F.lit("delete").alias("op"), "n")
    return come.unionByName(gone).groupBy("op").agg(F.sum("n").alias("n")).select("op", F.lit(UNCHANGED).alias("code"), "n")


def window_width(events: DataFrame, width: int) -> int:
    """A width from 1 to 99 is a percentage of the time extent; a negative one is the whole extent."""
    ends = events.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    if ends["a"] is None:
        return max(0, width)
    if 0 < width < 100:
        return (ends["b"] - ends["a"]) * width // 100
    return ends["b"] if width < 0 else width


def reinsert_sample(edges: DataFrame, sample: DataFrame, n: int) -> DataFrame:
    """One row: the forest's weight before, after the sample's edges were deleted, and after they were put back, and the sample's size.

    The forest of all edges but the sample is found first, by all tasks: whatever part of the sample
    is there, no other edge outside the sample can be in the forest. The replay in one task then has
    this forest and the sample alone.
    """
    edge = ["src", "dest", "weight", "ts"]
    some = stored(sample.select(*edge).distinct(), "sample")
    rest = forest(edges.select(*edge).join(some, edge, "left_anti"))
    there = edges.select(*edge).join(some, edge, "left_semi").distinct()
    rows = rest.withColumn("sampled", F.lit(False)).unionByName(there.withColumn("sampled", F.lit(True)))

    def run(batches):
        parts = [batch.to_pydict() for batch in batches]
        rows = [(e, s) for p in parts for e, s in zip(zip(*(p[c] for c in edge), strict=True), p["sampled"], strict=True)]
        live = DynamicForest.of(n, [e for e, _ in rows])
        weights = [live.weight()]
        for change in (live.delete, live.insert):
            for e, sampled in rows:
                if sampled:
                    change(e)
            weights.append(live.weight())
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*weights, sum(s for _, s in rows))], ["before", "without", "after", "n_sampled"])

    return rows.repartition(1).mapInArrow(run, "before bigint, without bigint, after bigint, n_sampled bigint")
