"""Index maintenance as timestamps arrive, and sliding windows over streams.

The state is the alive table: edges with s < t at the last timestamp seen. It answers every window
start, so an edge is never deleted for sliding out; a row goes only when it is dead (s = t) or older
than the widest window asked for. Rows not in today's forest stay, as they are what replaces edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import EDGE, OPEN
from ..operators.forest import local_forest, spanning_mask
from ..operators.staircase import expiry, scan, staircase

_STEP = "src int, dest int, weight int, t int, s int, te_from int"


class Alive:
    """Alive edges (src, dest, weight, t) and their s at the last timestamp."""

    def __init__(self, edges: np.ndarray | None = None, s: np.ndarray | None = None) -> None:
        self.edges = np.empty((0, 4), np.int64) if edges is None else edges
        self.s = np.empty(0, np.int64) if s is None else s

    def advance(self, te: int, bucket: np.ndarray, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Take in the edges of timestamp te (reduced to their forest); returns all edges looked at and their s."""
        if len(bucket):
            bucket = bucket[spanning_mask(np.zeros(len(bucket), np.int64), *bucket.T)]
        live = np.concatenate([self.edges, bucket])
        s = expiry(live)
        stay = s < live[:, 3]
        if width is not None:
            stay &= live[:, 3] >= te - width
        self.edges, self.s = live[stay], s[stay]
        return live, s

    def forest(self, start: int) -> np.ndarray:
        """The forest of [start, last timestamp]."""
        return self.edges[(self.s < start) & (start <= self.edges[:, 3])]


def alive_table(steps: DataFrame) -> DataFrame:
    """(src, dest, weight, t, s) of the edges that are still in some window's forest after the last timestamp."""
    last = steps.groupBy("src", "dest", "weight", "t").agg(F.max("s").alias("s"))
    return last.where("s < t")


def append(steps: DataFrame, new_edges: DataFrame, total: int, new_total: int) -> DataFrame:
    """The staircase over ``new_total`` timestamps from that over the first ``total`` and the edges since.

    Only alive rows and the new timestamps' forests are looked at. Timestamps build on each other, so
    this is one task for each call, over data of the size of the alive table.
    """
    fresh = local_forest(new_edges.where(F.col("ts").between(total, new_total - 1)))
    base = alive_table(steps)
    rows = base.unionByName(fresh.select("src", "dest", "weight", F.col("ts").alias("t"), F.lit(-2).alias("s")))

    def run(table: pa.Table) -> pa.Table:
        rows = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("src", "dest", "weight", "t")], axis=1)
        seen = {tuple(e): v for e, v in zip(rows.tolist(), table.column("s").to_pylist(), strict=True) if v > -2}
        out = []
        for te, live, s in scan(rows, total, new_total - 1):
            for edge, value in zip(map(tuple, live.tolist()), s.tolist(), strict=True):
                if seen.get(edge) != value:
                    seen[edge] = value
                    out.append((*edge, value, te))
        return pa.table([pa.array(x) for x in np.array(out, np.int32).reshape(-1, 6).T], names=["src", "dest", "weight", "t", "s", "te_from"])

    return steps.unionByName(rows.groupBy(F.lit(0).alias("all")).applyInArrow(lambda key, t: run(t), _STEP))


def incremental_staircase(edges: DataFrame, base: int, total: int, blocks: int = 8, batch: int | None = None) -> DataFrame:
    """Base over the first ``base`` timestamps (0 is legal), the rest appended, ``batch`` timestamps at a time."""
    steps = staircase(edges.where(F.col("ts") < base), blocks, t_total=base)
    step = batch or max(1, total - base)
    for first in range(base, total, step):
        steps = append(steps, edges, first, min(total, first + step))
    return steps


def append_rectangles(open_: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(closed now, open now) from the open rectangles (t2 = OPEN) and the steps of appended timestamps.

    Rectangles closed before are not touched, so their files never change.
    """
    edge = ["src", "dest", "weight", "t"]
    follow = F.lead("te_from", 1, OPEN).over(Window.partitionBy(*edge).orderBy("te_from"))
    fresh = changes.select(*edge, "s", F.col("te_from").alias("t1"), follow.alias("t2")).where("s < t")
    first = changes.groupBy(*edge).agg(F.min("te_from").alias("until"))
    touched = open_.join(first, edge, "left")
    closed = touched.where("until is not null").select(*edge, "s", "t1", F.col("until").alias("t2")).unionByName(fresh.where(F.col("t2") < OPEN))
    return closed, touched.where("until is null").select(*edge, "s", "t1", "t2").unionByName(fresh.where(F.col("t2") == OPEN))


_FOREST = "graph_id bigint, te int, src int, dest int, weight int, ts int"


def sliding_forest(edges: DataFrame, width: int, total: int) -> DataFrame:
    """(graph_id, te, src, dest, weight, ts): the forest of [te - width, te] for every te below ``total``; graphs run apart."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = np.stack([table.column(c).to_numpy().astype(np.int64) for c in EDGE], axis=1)
        state, parts = Alive(), []
        for te in range(total):
            state.advance(te, rows[rows[:, 3] == te], width)
            found = state.forest(max(0, te - width))
            parts.append(np.column_stack([np.full(len(found), te), found]))
        out = np.concatenate(parts).astype(np.int32).T if parts else np.empty((5, 0), np.int32)
        ids = pa.array([key[0].as_py()] * out.shape[1], pa.int64())
        return pa.table([ids, *map(pa.array, out)], names=["graph_id", "te", "src", "dest", "weight", "ts"])

    rows = edges if "graph_id" in edges.columns else edges.withColumn("graph_id", F.lit(0).cast("bigint"))
    small = rows.select("graph_id", *EDGE)
    return small.groupBy("graph_id").applyInArrow(run, _FOREST)


_STATE = "now bigint, alive array<array<bigint>>, waiting array<array<bigint>>"


def sliding_stream(events: DataFrame, width: int, bucket_seconds: int, origin_seconds: int = 0, delay: str = "0 seconds") -> DataFrame:
    """The same over a stream (graph_id, event_time, src, dest, weight), appended when the watermark passes a bucket.

    Rows later than ``delay`` behind the latest event are dropped. The state of a graph is its alive
    rows within the width and the rows of buckets still open.
    """

    def finish(now: int, alive: list, waiting: list, limit: int) -> tuple[int, list, list, list]:
        """Advance over every bucket before ``limit``; empty ones between also count."""
        state = Alive(np.array([r[:4] for r in alive], np.int64).reshape(-1, 4), np.array([r[4] for r in alive], np.int64))
        by: dict[int, set] = {}
        for r in waiting:
            by.setdefault(r[3], set()).add(tuple(r))
        out = []
        due = [b for b in by if b < limit]
        if now < 0 and due:
            now = min(due)
        while now >= 0 and now < limit and (due or len(state.edges)):
            state.advance(now, np.array(sorted(by.pop(now, ())), np.int64).reshape(-1, 4), width)
            out += [(now, *e) for e in state.forest(max(0, now - width)).tolist()]
            due = [b for b in by if b < limit]
            now += 1
        if now >= 0 and now < limit and not len(state.edges):
            now = -1  # nothing left: the next bucket with rows starts anew
        return now, [[*e, int(v)] for e, v in zip(state.edges.tolist(), state.s.tolist(), strict=True)], [list(r) for rs in by.values() for r in rs], out

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, alive, waiting = state.get if state.exists else (-1, [], [])
        waiting = [list(map(int, r)) for r in waiting]
        alive = [list(map(int, r)) for r in alive]
        if not state.hasTimedOut:
            for frame in frames:
                waiting += frame[["src", "dest", "weight", "bucket"]].astype("int64").values.tolist()
        mark = state.getCurrentWatermarkMs()
        limit = max(0, (mark // 1000 - origin_seconds) // bucket_seconds)
        waiting = [r for r in waiting if r[3] >= now]
        now, alive, waiting, out = finish(now, alive, waiting, limit)
        state.update((now, alive, waiting))
        if waiting or alive:
            ahead = (max(now, min((r[3] for r in waiting), default=now)) + 1) * bucket_seconds + origin_seconds
            state.setTimeoutTimestamp(max(ahead * 1000, mark + 1))
        frame = pd.DataFrame(out, columns=["te", "src", "dest", "weight", "ts"], dtype="int32")
        frame.insert(0, "graph_id", key[0])
        yield frame

    bucket = F.floor((F.unix_timestamp("event_time") - origin_seconds) / bucket_seconds).cast("int")
    rows = events.withWatermark("event_time", delay).withColumn("bucket", bucket).where("src <> dest and bucket >= 0")
    return rows.groupBy("graph_id").applyInPandasWithState(step, _FOREST, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def maintain(stream: DataFrame, folder: str, checkpoint: str):
    """A streaming query that appends each micro-batch (EDGE columns, timestamps in order) to the staircase in ``folder``.

    Batch k writes ``steps/batch=k`` and the alive table ``alive/batch=k``, and reads ``alive/batch=k-1``,
    so a batch that runs again replaces its own output and nothing else.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            bounds = None
        else:
            bounds = batch.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
        schema = "src int, dest int, weight int, t int, s int"
        alive = spark.read.schema(schema).parquet(f"{folder}/alive/batch={number - 1}") if number else spark.createDataFrame([], schema)
        steps = alive.withColumn("te_from", F.lit(-1))
        made = append(steps, batch.select(*EDGE), bounds["a"], bounds["b"] + 1) if bounds else steps
        made.where("te_from >= 0").write.mode("overwrite").parquet(f"{folder}/steps/batch={number}")
        fresh = spark.read.schema(f"{schema}, te_from int").parquet(f"{folder}/steps/batch={number}")
        alive_table(steps.unionByName(fresh)).write.mode("overwrite").parquet(f"{folder}/alive/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
