"""Command line: ``python -m sylva COMMAND ...``. Paths are files or folders that Spark can reach."""

from __future__ import annotations

import argparse
import resource
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .functions.order import systematic_sample
from .operators.forest import weight_by_key
from .operators.staircase import mean_lifetime, staircase
from .plans import index, query, windows
from .sources import files
from .storage import stored
from .streaming import dynamic, sliding

READERS = {"parquet": lambda spark, path: spark.read.parquet(path), "binary": files.read_binary_graph, "text": files.read_text_graph}


def _graph(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return model.edges(READERS[args.format](spark, args.graph))


def _stats(spark: SparkSession, args: argparse.Namespace) -> None:
    model.graph_stats(_graph(spark, args)).show()


def _windows(spark: SparkSession, args: argparse.Namespace) -> None:
    total = model.t_count(_graph(spark, args))
    files.write_windows(windows.generate(spark, args.count, args.ratio, total, args.seed), args.out, "overwrite")


def _build(spark: SparkSession, args: argparse.Namespace) -> None:
    edges = stored(_graph(spark, args), "graph")
    total, began = model.t_count(edges), time.perf_counter()
    if args.base_ratio is None:
        steps = staircase(edges, args.blocks, t_total=total)
    else:
        steps = sliding.incremental_staircase(edges, int(total * args.base_ratio), total, args.blocks)
    steps = stored(steps, "staircase")
    index.save(steps, total, args.index)
    index.sizes(spark, args.index).show()
    print(f"built in {time.perf_counter() - began:.1f} s; mean lifetime {mean_lifetime(steps, total).first()[0]}; peak memory of the driver's process {resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024:.0f} MB")


def _query(spark: SparkSession, args: argparse.Namespace) -> None:
    asked = files.read_windows(spark, args.windows)
    began = time.perf_counter()
    if args.strategy in ("online", "merged"):
        found = query.window_forest(_graph(spark, args), asked, args.strategy)
    else:
        found = index.load(spark, args.index).query(asked, args.strategy)
    found.write.mode("overwrite").parquet(args.out)
    seconds = time.perf_counter() - began
    print(f"{seconds:.2f} s, {1000 * seconds / max(1, asked.count()):.3f} ms a window")
    weight_by_key(spark.read.parquet(args.out), "window_id").orderBy("window_id").show(5)


def _stream(spark: SparkSession, args: argparse.Namespace) -> None:
    """Replays a time-ordered event file over a sliding window and prints how often each result code occurred."""
    events = files.read_binary_stream(spark, args.graph) if args.format == "binary" else spark.read.parquet(args.graph)
    seq = F.row_number().over(model.Window.partitionBy("graph_id").orderBy("t", "weight", "src", "dest"))
    events = events.withColumn("graph_id", F.lit(0).cast("bigint")).withColumn("seq", seq.cast("bigint"))
    n = events.agg(F.greatest(F.max("src"), F.max("dest")) + 1).first()[0] or 0
    width = dynamic.window_width(events, args.width)
    dynamic.code_counts(dynamic.replay(dynamic.sliding_operations(events, width, args.drain), n)).orderBy("op", "code").show()


def _sample(spark: SparkSession, args: argparse.Namespace) -> None:
    one = model.undirected(_graph(spark, args)).select(*model.EDGE).distinct()
    n = model.graph_stats(one).first()["n"]
    dynamic.reinsert_sample(one, systematic_sample(one, args.count), n).show()


def _prepare(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.kind == "road":
        made = files.read_road(spark, args.graph)
    elif args.kind == "unweighted":
        made = files.unweighted(files.read_loose_edges(spark, args.graph))
    elif args.kind == "adjacency":
        made = model.adjacency(files.read_loose_edges(spark, args.graph))
    else:
        made = files.event_stream(files.read_loose_temporal(spark, args.graph), bipartite=args.kind == "bipartite-stream")
    made.write.mode("overwrite").parquet(args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sylva", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *names: str, **options: dict) -> None:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for n in names:
            p.add_argument(n)
        p.add_argument("--format", choices=sorted(READERS), default="parquet")
        for n, o in options.items():
            p.add_argument(f"--{n.replace('_', '-')}", **o)

    command("stats", _stats, "graph")
    command("windows", _windows, "graph", "out", count={"type": int, "default": 1000}, ratio={"type": float, "default": 0.2}, seed={"type": int, "default": 0})
    command("build", _build, "graph", "index", blocks={"type": int, "default": 8}, base_ratio={"type": float})
    command("query", _query, "graph", "windows", "out", index={}, strategy={"choices": query.STRATEGIES, "default": "segment"})
    command("stream", _stream, "graph", width={"type": int, "default": 10}, drain={"action": "store_true"})
    command("sample", _sample, "graph", count={"type": int, "default": 1000})
    command("prepare", _prepare, "graph", "out", kind={"choices": ["road", "unweighted", "adjacency", "stream", "bipartite-stream"], "default": "stream"})
    return top


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    args.run(SparkSession.builder.appName("sylva").getOrCreate(), args)
