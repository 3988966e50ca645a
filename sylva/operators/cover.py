"""Covers of rectangles by dyadic intervals or square cells, so that a stabbing query is an equi-join.

All numbers come from sequences and arithmetic on columns; the domain is padded to a power of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def levels(total: int) -> int:
    """The least K with 2**K >= total."""
    return max(0, (max(1, total) - 1).bit_length())


def _dyadic(low: Column, high: Column, k: int) -> Column:
    """The (level, pos) of the dyadic intervals that make up [low, high): at most two a level."""

    def at(level: int) -> Column:
        size = F.lit(1 << level)
        a, b = F.ceil(low / size).cast("int"), F.floor(high / size).cast("int")
        node = lambda p: F.struct(F.lit(level).alias("level"), p.alias("pos"))
        # an odd first node or an even last one is not its parent's half of the cover
        return F.array(F.when((a < b) & (a % 2 == 1), node(a)), F.when((a < b) & (b % 2 == 1), node(b - 1)))

    return F.filter(F.flatten(F.array(*(at(i) for i in range(k + 1)))), lambda x: x.isNotNull())


def end_nodes(rects: DataFrame, total: int) -> DataFrame:
    """A row for each node (level, pos) of the cover of [t1, t2) on the axis of window ends."""
    k = levels(total)
    cover = _dyadic(F.col("t1"), F.least("t2", F.lit(1 << k)), k)
    return rects.where("s < t").withColumn("node", F.explode(cover)).select(*rects.columns, "node.level", "node.pos")


def start_nodes(rects: DataFrame, total: int) -> DataFrame:
    """The same on the axis of window starts, for [s + 1, t + 1)."""
    k = levels(total)
    cover = _dyadic(F.col("s") + 1, F.col("t") + 1, k)
    return rects.where("s < t").withColumn("node", F.explode(cover)).select(*rects.columns, "node.level", "node.pos")


def ancestors(windows: DataFrame, at: str, total: int) -> DataFrame:
    """The K + 1 nodes above a window's end (or start), one row each."""
    nodes = [F.struct(F.lit(i).alias("level"), F.shiftright(at, i).alias("pos")) for i in range(levels(total) + 1)]
    return windows.withColumn("node", F.explode(F.array(*nodes))).select(*windows.columns, "node.level", "node.pos")


def cells(rects: DataFrame, total: int) -> DataFrame:
    """A row for each square cell (level, cx, cy) of the quadtree cover of [t1, t2) x [s + 1, t + 1).

    Level by level: a cell inside the rectangle whose parent is not. On a level these lie in the
    rectangle's box of whole cells outside the box of whole parents, which leaves strips of one cell
    at each side; only those strips are listed.
    """
    k = levels(total)
    x1, x2, y1, y2 = F.col("t1"), F.least("t2", F.lit(1 << k)), F.col("s") + 1, F.col("t") + 1

    def at(level: int) -> Column:
        size = 1 << level
        up = lambda c, n: F.ceil(c / F.lit(n)).cast("int")
        down = lambda c, n: F.floor(c / F.lit(n)).cast("int")
        box = F.struct(up(x1, size).alias("a"), down(x2, size).alias("b"), up(y1, size).alias("c"), down(y2, size).alias("d"))
        if level == k:
            inner = F.struct(*(F.lit(0).alias(n) for n in "ABCD"))
        else:
            two = 2 * size
            A, B, C, D = up(x1, two) * 2, down(x2, two) * 2, up(y1, two) * 2, down(y2, two) * 2
            none = (A >= B) | (C >= D)
            inner = F.struct(*(F.when(none, F.lit(0)).otherwise(v).alias(n) for n, v in zip("ABCD", (A, B, C, D), strict=True)))
        span = lambda lo, hi: F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))
        cell = lambda x, y: F.struct(F.lit(level).alias("level"), x.alias("cx"), y.alias("cy"))

        def listed(o: Column) -> Column:
            a, b, c, d, A, B, C, D = o["box"]["a"], o["box"]["b"], o["box"]["c"], o["box"]["d"], o["in"]["A"], o["in"]["B"], o["in"]["C"], o["in"]["D"]
            full = A >= B
            columns = F.when(full, span(a, b)).otherwise(F.concat(span(a, A), span(B, b)))
            whole = F.flatten(F.transform(columns, lambda x: F.transform(span(c, d), lambda y: cell(x, y))))
            rows = F.concat(span(c, C), span(D, d))
            sides = F.flatten(F.transform(span(F.greatest(a, A), F.least(b, B)), lambda x: F.transform(rows, lambda y: cell(x, y))))
            return F.when(full, whole).otherwise(F.concat(whole, sides))

        return F.transform(F.array(F.struct(box.alias("box"), inner.alias("in"))), listed)[0]

    cover = F.flatten(F.array(*(at(level) for level in range(k + 1))))
    return rects.where("s < t").withColumn("cell", F.explode(cover)).select(*rects.columns, "cell.level", "cell.cx", "cell.cy")


def window_cells(windows: DataFrame, total: int) -> DataFrame:
    """The K + 1 cells above a window, one row each."""
    found = [F.struct(F.lit(i).alias("level"), F.shiftright("te", i).alias("cx"), F.shiftright("ts", i).alias("cy")) for i in range(levels(total) + 1)]
    return windows.withColumn("cell", F.explode(F.array(*found))).select(*windows.columns, "cell.level", "cell.cx", "cell.cy")


def cover_histogram(rects: DataFrame, total: int) -> DataFrame:
    """(n_cells, n_rects): how many rectangles have a cover of so many cells."""
    return cells(rects, total).groupBy("src", "dest", "weight", "t", "t1").agg(F.count("*").alias("n_cells")).groupBy("n_cells").agg(F.count("*").alias("n_rects"))
