"""Rectangles (s, t] x [t1, t2) of an edge's validity, intervals, and windows as points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_c = F.col


def stabs(ts: Column, te: Column) -> Column:
    """Whether the window (ts, te) lies in the row's rectangle: open below in ts, open above in te."""
    return (_c("t1") <= te) & (te < _c("t2")) & (_c("s") < ts) & (ts <= _c("t"))


def non_empty(rects: DataFrame) -> DataFrame:
    return rects.where("s < t")


def valid_record(record: Column, ts: Column, te: Column) -> Column:
    """Validity of an array of (s, te_from): the last pair not after te decides."""
    last = F.try_element_at(F.filter(record, lambda x: x["te_from"] <= te), F.lit(-1))
    return F.coalesce(last["s"] < ts, F.lit(False))


def intersects(a: str, b: str) -> Column:
    """Whether two closed rectangles, structs (x1, x2, y1, y2), touch."""
    return (_c(f"{a}.x1") <= _c(f"{b}.x2")) & (_c(f"{b}.x1") <= _c(f"{a}.x2")) & (_c(f"{a}.y1") <= _c(f"{b}.y2")) & (_c(f"{b}.y1") <= _c(f"{a}.y2"))


def intersection(a: str, b: str) -> Column:
    """The common rectangle if it has an area, else null."""
    x1, x2 = F.greatest(f"{a}.x1", f"{b}.x1"), F.least(f"{a}.x2", f"{b}.x2")
    y1, y2 = F.greatest(f"{a}.y1", f"{b}.y1"), F.least(f"{a}.y2", f"{b}.y2")
    return F.when((x1 < x2) & (y1 < y2), F.struct(x1.alias("x1"), x2.alias("x2"), y1.alias("y1"), y2.alias("y2")))


def is_empty(a: str) -> Column:
    return (_c(f"{a}.x1") >= _c(f"{a}.x2")) | (_c(f"{a}.y1") >= _c(f"{a}.y2"))


def _ends(a: str) -> tuple[Column, Column]:
    return F.least(f"{a}.x1", f"{a}.x2"), F.greatest(f"{a}.x1", f"{a}.x2")


def line_intersects(a: str, b: str) -> Column:
    """Whether two intervals, structs (x1, x2) with ends in any order, overlap by more than a point."""
    (a1, a2), (b1, b2) = _ends(a), _ends(b)
    return F.greatest(a1, b1) < F.least(a2, b2)


def line_intersection(a: str, b: str) -> Column:
    (a1, a2), (b1, b2) = _ends(a), _ends(b)
    return F.when(line_intersects(a, b), F.struct(F.greatest(a1, b1).alias("x1"), F.least(a2, b2).alias("x2")))


def line_is_empty(a: str) -> Column:
    return _c(f"{a}.x1") == _c(f"{a}.x2")
