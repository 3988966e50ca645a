"""The forest of every window of a batch, by strategies that give the same rows.

online: local forests of the window's timestamps, reduced per window.
merged: forests of dyadic runs of timestamps, built level by level, reduced per window.
staircase, sorted: the window's point in the rectangles of edge validity, by timestamp or by sorted files.
segment (either axis), quadrant: the same as an equi-join on dyadic nodes or square cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import stabs
from ..model import EDGE, t_count
from ..operators import cover
from ..operators.forest import keyed_forest, local_forest
from ..operators.staircase import rectangles, staircase
from .windows import clip

RESULT = ["window_id", *EDGE]
STRATEGIES = ("online", "merged", "staircase", "sorted", "segment", "segment_start", "quadrant")


def t_part(t: str, span: int) -> Column:
    """The folder of a saved index that holds the rectangles of t."""
    return F.floor(F.col(t) / F.lit(span)).cast("int")


def node_part(at: str, total: int) -> Column:
    """The folder, within its level, of a node or cell: its position's first three bits."""
    return F.expr(f"shiftright({at}, greatest(0, {cover.levels(total) - 3} - level))")


def _by_node(table: DataFrame, wide: DataFrame, keys: list[str], total: int) -> DataFrame:
    if "part" in table.columns:
        wide, keys = wide.withColumn("part", node_part(keys[1], total)), [*keys, "part"]
    return table.join(wide, keys)


def _result(joined: DataFrame) -> DataFrame:
    return joined.select("window_id", "src", "dest", "weight", F.col("t").alias("ts"))


def online(edges: DataFrame, windows: DataFrame, total: int, reduced: bool = False) -> DataFrame:
    """Equi-join of each window's timestamps with the local forests, then one forest a window."""
    base = edges if reduced else local_forest(edges)
    wide = clip(windows, total).select("window_id", F.explode(F.sequence("ts", "te")).alias("ts"))
    return keyed_forest(base.join(wide, "ts"), "window_id")


def merged(edges: DataFrame, windows: DataFrame, total: int, reduced: bool = False) -> DataFrame:
    """A window needs at most two dyadic runs a level, so fewer rows meet than with one run a timestamp."""
    k = cover.levels(total)
    node = edges if reduced else local_forest(edges)
    node = node.select(F.col("ts").cast("bigint").alias("pos"), *EDGE)
    runs = node.select(F.lit(0).alias("level"), "pos", *EDGE)
    for level in range(1, k + 1):
        node = keyed_forest(node.withColumn("pos", F.shiftright("pos", 1)), "pos")
        runs = runs.unionByName(node.select(F.lit(level).alias("level"), "pos", *EDGE))
    spans = clip(windows, total).select("window_id", F.col("ts").alias("t1"), (F.col("te") + 1).alias("t2"), F.lit(-1).alias("s"), F.lit(0).alias("t"))
    wide = cover.end_nodes(spans, total).select("window_id", "level", F.col("pos").cast("bigint").alias("pos"))
    return keyed_forest(runs.join(wide, ["level", "pos"]), "window_id")


def by_staircase(rects: DataFrame, windows: DataFrame, total: int, span: int | None = None) -> DataFrame:
    """Equi-join on the edge's timestamp, and on its folder where the rectangles are saved in such, then the rectangle's test."""
    wide = clip(windows, total).withColumn("t", F.explode(F.sequence("ts", "te")))
    if span:
        wide = wide.withColumn("t_part", t_part("t", span))
    return _result(rects.join(wide, ["t", "t_part"] if span else "t").where(stabs(F.col("ts"), F.col("te"))).drop("ts"))


def by_sorted(rects: DataFrame, windows: DataFrame, total: int) -> DataFrame:
    """Equi-join on t1: a window looks at rectangles that begin at each t1 up to its end.

    For comparison: a window of end te makes te + 1 rows, where the covers make K + 1.
    """
    wide = clip(windows, total).withColumn("t1", F.explode(F.sequence(F.lit(0), F.col("te"))))
    return _result(rects.join(wide, "t1").where(stabs(F.col("ts"), F.col("te"))).drop("ts"))


def by_segment(nodes: DataFrame, windows: DataFrame, total: int) -> DataFrame:
    """Equi-join on the nodes above the window's end, and a test of its start."""
    wide = cover.ancestors(clip(windows, total), "te", total)
    joined = _by_node(nodes, wide, ["level", "pos"], total).where((F.col("s") < F.col("ts")) & (F.col("ts") <= F.col("t")))
    return _result(joined.drop("ts"))


def by_segment_start(nodes: DataFrame, windows: DataFrame, total: int) -> DataFrame:
    """Equi-join on the nodes above the window's start, and a test of its end."""
    wide = cover.ancestors(clip(windows, total), "ts", total)
    joined = _by_node(nodes, wide, ["level", "pos"], total).where((F.col("t1") <= F.col("te")) & (F.col("te") < F.col("t2")))
    return _result(joined.drop("ts"))


def by_quadrant(cells: DataFrame, windows: DataFrame, total: int) -> DataFrame:
    """Equi-join on the cells above the window's point; nothing is left to test."""
    wide = cover.window_cells(clip(windows, total), total)
    return _result(_by_node(cells, wide, ["level", "cx", "cy"], total).drop("ts"))


@dataclass
class Index:
    """What index-backed strategies read; each table is made when first used."""

    rects: DataFrame
    total: int
    end_nodes: DataFrame | None = None
    start_nodes: DataFrame | None = None
    cells: DataFrame | None = None
    t_span: int | None = None  # of a saved index: how many t a folder of rectangles holds

    @classmethod
    def build(cls, edges: DataFrame, blocks: int = 8, reduced: bool = False) -> Index:
        total = t_count(edges)
        return cls(rectangles(staircase(edges, blocks, reduced, total)), total)

    def query(self, windows: DataFrame, strategy: str = "segment") -> DataFrame:
        if strategy == "staircase":
            return by_staircase(self.rects, windows, self.total, self.t_span)
        if strategy == "sorted":
            return by_sorted(self.rects, windows, self.total)
        if strategy == "segment":
            return by_segment(self.end_nodes or cover.end_nodes(self.rects, self.total), windows, self.total)
        if strategy == "segment_start":
            return by_segment_start(self.start_nodes or cover.start_nodes(self.rects, self.total), windows, self.total)
        if strategy == "quadrant":
            return by_quadrant(self.cells or cover.cells(self.rects, self.total), windows, self.total)
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)}")


def window_forest(edges: DataFrame, windows: DataFrame, strategy: str = "auto", index: Index | None = None) -> DataFrame:
    """(window_id, src, dest, weight, ts) for every edge of every window's forest.

    ``auto`` takes the segment cover of an index that is given, else evaluates online.
    """
    if strategy == "auto":
        strategy = "segment" if index else "online"
    if strategy in ("online", "merged"):
        total = index.total if index else t_count(edges)
        return (online if strategy == "online" else merged)(edges, windows, total)
    return (index or Index.build(edges)).query(windows, strategy)


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """(window_id, n_left, n_right, n_both, weight_left, weight_right) for each window with an edge in either result; the results are equal if all counts are."""
    sides = [x.select(*RESULT, F.lit(i == 0).alias("l"), F.lit(i == 1).alias("r")) for i, x in enumerate((left, right))]
    each = sides[0].unionByName(sides[1]).groupBy(*RESULT).agg(F.count_if("l").alias("l"), F.count_if("r").alias("r"))
    heavy = F.col("weight").cast("bigint")
    return each.groupBy("window_id").agg(
        F.sum("l").alias("n_left"), F.sum("r").alias("n_right"), F.sum(F.least("l", "r")).alias("n_both"), F.sum(heavy * F.col("l")).alias("weight_left"), F.sum(heavy * F.col("r")).alias("weight_right")
    )


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one result has and the other lacks, with the side that has them; none if the strategies agree."""
    left, right = left.select(*RESULT), right.select(*RESULT)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
