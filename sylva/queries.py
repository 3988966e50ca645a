"""Named queries over the graphs of graphs.py, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graphs, model
from .functions import geometry, order
from .operators import cover, forest, staircase
from .plans import index, query, windows
from .sources import files
from .storage import new_folder, stored
from .streaming import dynamic, sliding

#: Quarters from 1995-01-02 to 2001-11-04.
QUARTERS = 28
NATIONS = 25
COUNT, RATIO = 200, 0.2
INDEXED = ("staircase", "sorted", "segment", "segment_start", "quadrant")

Query = Callable[[SparkSession, str], DataFrame]


def _windows(spark: SparkSession) -> DataFrame:
    return windows.generate(spark, COUNT, RATIO, QUARTERS)


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(forest.local_forest(graphs.trade(spark, sf_dir)), "local-forest")


def _index(spark: SparkSession, sf_dir: str) -> query.Index:
    base = _local(spark, sf_dir)
    return query.Index(staircase.rectangles(stored(staircase.staircase(base, reduced=True, t_total=QUARTERS), "staircase")), QUARTERS)


def _by(strategy: str) -> Query:
    return lambda spark, sf_dir: _index(spark, sf_dir).query(_windows(spark), strategy)


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.graph_stats(graphs.trade(spark, sf_dir))


def edges_per_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.edges_per_timestamp(graphs.trade(spark, sf_dir))


def snapshot_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.snapshot(graphs.trade(spark, sf_dir), 4, 6)


def timestamp_point_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.at_timestamp(graphs.trade(spark, sf_dir), 5)


def base_stream_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.split_point(graphs.trade(spark, sf_dir), 0.8)


def generate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark)


def canonical_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge's place in the canonical order of its timestamp."""
    return order.canonical_rank(graphs.trade(spark, sf_dir), "ts").select("src", "dest", "weight", "ts", "rank")


def local_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.local_forest(graphs.trade(spark, sf_dir))


def window_msf_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.online(graphs.trade(spark, sf_dir), _windows(spark), QUARTERS)


def window_msf_kway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.merged(_local(spark, sf_dir), _windows(spark), QUARTERS, reduced=True)


def msf_whole_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.forest(graphs.trade(spark, sf_dir))


def msf_boruvka(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest of every timestamp by joins and aggregations alone."""
    return forest.boruvka_forest(graphs.trade(spark, sf_dir).withColumn("k", F.col("ts")), "k").select("src", "dest", "weight", "ts")


def msf_weight_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.weight_by_key(_by("segment")(spark, sf_dir), "window_id")


def msf_components_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.components_by_key(_by("segment")(spark, sf_dir), _windows(spark), "window_id", NATIONS)


def msf_rejected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges of the graph that are not in its forest."""
    edges = stored(graphs.trade(spark, sf_dir), "trade").withColumn("k", F.lit(0).cast("bigint"))
    return forest.split_forest(edges, "k").where("not picked").select("src", "dest", "weight", "ts")


def staircase_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staircase.staircase(_local(spark, sf_dir), blocks=1, reduced=True, t_total=QUARTERS)


def staircase_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staircase.staircase(_local(spark, sf_dir), blocks=8, reduced=True, t_total=QUARTERS)


def staircase_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding.incremental_staircase(_local(spark, sf_dir), 22, QUARTERS, batch=2)


def expiry_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).rects


def mean_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staircase.mean_lifetime(staircase_records(spark, sf_dir), QUARTERS)


def mean_t_per_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staircase.mean_t_per_s(staircase.rectangles(staircase_records(spark, sf_dir), keep_empty=True))


def segment_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rectangles each node of the dyadic cover holds."""
    return cover.end_nodes(_index(spark, sf_dir).rects, QUARTERS).groupBy("level", "pos").agg(F.count("*").alias("n_rects"))


def quad_cover_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover.cover_histogram(_index(spark, sf_dir).rects, QUARTERS)


def strategy_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each window the edges and weights that the online and the quadrant strategies give, and how many edges both do."""
    base = _local(spark, sf_dir)
    return query.agreement(query.online(base, _windows(spark), QUARTERS, reduced=True), _by("quadrant")(spark, sf_dir))


def saved_index(strategy: str) -> Query:
    """The index is built, written to files, loaded and asked."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder, asked = new_folder(spark, "index"), new_folder(spark, "windows")
        index.save(stored(staircase.staircase(_local(spark, sf_dir), reduced=True, t_total=QUARTERS), "staircase"), QUARTERS, folder)
        files.write_windows(_windows(spark), asked)
        return index.load(spark, folder).query(files.read_windows(spark, asked), strategy)

    return run


def saved_staircase(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "index")
    index.save(stored(staircase_records(spark, sf_dir), "staircase"), QUARTERS, folder)
    return index.load_staircase(spark, folder).select("src", "dest", "weight", "t", "s", "te_from")


def index_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of a saved index."""
    folder = new_folder(spark, "index")
    index.save(stored(staircase_records(spark, sf_dir), "staircase"), QUARTERS, folder)
    loaded = index.load(spark, folder)
    tables = {"staircase": index.load_staircase(spark, folder), "rects": loaded.rects, "rect_nodes": loaded.end_nodes, "rect_start_nodes": loaded.start_nodes, "rect_cells": loaded.cells}
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts).join(index.sizes(spark, folder).where("n_bytes > 0"), "name").select("name", "n_rows")


def appended_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangles of the first 22 quarters, closed and opened as the other six are appended, two at a time."""
    base = _local(spark, sf_dir)
    steps = stored(staircase.staircase(model.snapshot(base, 0, 21), reduced=True, t_total=22), "staircase")
    now = staircase.rectangles(steps)
    closed, open_ = now.where(F.col("t2") < model.OPEN), now.where(F.col("t2") == model.OPEN)
    for first in range(22, QUARTERS, 2):
        longer = stored(sliding.append(steps, base, first, first + 2), "staircase")
        more, open_ = sliding.append_rectangles(open_, longer.where(F.col("te_from") >= first))
        closed, open_, steps = closed.unionByName(more), stored(open_, "open"), longer
    return closed.unionByName(open_).where("s < t")


def record_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each window how many edges of its timestamps have a staircase, as an array, that is valid for it."""
    records = staircase.records(stored(staircase_records(spark, sf_dir), "staircase"))
    wide = _windows(spark).withColumn("t", F.explode(F.sequence("ts", "te")))
    joined = records.join(F.broadcast(wide), "t")  # COUNT windows
    return joined.where(geometry.valid_record(F.col("record"), F.col("ts"), F.col("te"))).groupBy("window_id").agg(F.count("*").alias("n_edges"))


def rectangle_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rectangle against the box of window ends 5 to 15 and starts 3 to 12: whether they touch, and what they have in common."""
    rects = _index(spark, sf_dir).rects
    a = F.struct(F.col("t1").alias("x1"), F.least("t2", F.lit(QUARTERS)).alias("x2"), F.col("s").alias("y1"), F.col("t").alias("y2"))
    box = F.struct(*(F.lit(v).alias(n) for n, v in (("x1", 5), ("x2", 15), ("y1", 3), ("y2", 12))))
    found = rects.select("src", "dest", "weight", "t", "t1", a.alias("a"), box.alias("b"))
    found = found.withColumn("both", geometry.intersection("a", "b"))
    return found.select(
        "src", "dest", "weight", "t", "t1", geometry.intersects("a", "b").alias("touches"), geometry.is_empty("a").alias("is_empty"),
        F.col("both.x1").alias("x1"), F.col("both.x2").alias("x2"), F.col("both.y1").alias("y1"), F.col("both.y2").alias("y2"),
        geometry.line_intersects("a", "b").alias("line_touches"), geometry.line_intersection("a", "b")["x2"].alias("line_end"), geometry.line_is_empty("a").alias("line_is_empty"),
    )


def file_text_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "text")
    files.write_text_graph(graphs.trade(spark, sf_dir), folder)
    return files.read_text_graph(spark, folder)


def file_binary_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "binary")
    files.write_binary_graph(graphs.trade(spark, sf_dir), folder)
    return files.read_binary_graph(spark, folder)


def file_binary_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "windows")
    files.write_binary_windows(_windows(spark), folder)
    return files.read_binary_windows(spark, folder).select("ts", "te")


def _sales_stream(spark: SparkSession, sf_dir: str, folder: str) -> None:
    events = graphs.trade(spark, sf_dir).select(F.col("ts").alias("t"), "weight", "src", "dest")
    files.write_binary_stream(events, folder, NATIONS)


def file_binary_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "events")
    _sales_stream(spark, sf_dir, folder)
    return files.read_binary_stream(spark, folder)


def file_stream_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event files read as a stream, file by file, into a table."""
    folder, out = new_folder(spark, "events"), new_folder(spark, "table")
    _sales_stream(spark, sf_dir, folder)
    writer = files.stream_events(spark, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(spark, "state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("t int, weight int, src int, dest int").parquet(out)


def _lines(spark: SparkSession, sf_dir: str, line: Column) -> str:
    folder = new_folder(spark, "lines")
    graphs.trade(spark, sf_dir).select(line.alias("value")).write.text(folder)
    return folder


def file_loose_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two ids, a weight and a time with different signs between them; the number of tokens is found from the lines."""
    return files.read_loose_edges(spark, _lines(spark, sf_dir, F.format_string("%d,%d;%d @%d", "src", "dest", "weight", "ts")))


def file_loose_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_loose_temporal(spark, _lines(spark, sf_dir, F.format_string("%d %d %d %d", "src", "dest", "weight", "ts")))


def file_road(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("ts") % 7 == 0, "c").otherwise("a")
    return files.read_road(spark, _lines(spark, sf_dir, F.concat_ws(" ", kind, "src", "dest", "weight")))


def file_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symmetric adjacency with parallel edges, written and read."""
    folder = new_folder(spark, "adjacency")
    files.write_adjacency(graphs.trade(spark, sf_dir), folder, multi_edge=True)
    return spark.read.parquet(folder).groupBy("src", "dest").agg(F.count("*").alias("n"), F.sum(F.col("weight").cast("bigint")).alias("sum_weight"))


def file_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "histogram")
    files.write_histogram(quad_cover_histogram(spark, sf_dir), folder)
    return spark.read.csv(folder, sep=" ", schema="n_cells bigint, n_rects bigint")


def undirected_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights made from pairs: all in their range, and the same for the same pair whatever its direction."""
    session = graphs.session(spark, sf_dir)
    turned = session.select(F.col("dest").alias("src"), F.col("src").alias("dest"))
    found = files.unweighted(session.select("src", "dest"), weights=1000).join(files.unweighted(turned, weights=1000).withColumnRenamed("weight", "again"), ["src", "dest"])
    return found.agg(F.count("*").alias("n"), F.count_if(F.col("weight").between(1, 1000)).alias("n_in_range"), F.count_if(F.col("weight") == F.col("again")).alias("n_equal"))


def time_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each timestamp's edges in the files of a table sorted by time: their number, and in how many partitions they are."""
    rows = order.by_timestamp(graphs.trade(spark, sf_dir)).withColumn("p", F.spark_partition_id())
    return rows.groupBy("ts").agg(F.count("*").alias("n_edges"), F.count_distinct("p").alias("n_parts"))


def sorted_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rectangles do not come after the one before them in their partition's order by t1, t2 descending, s and t descending."""
    rects = _index(spark, sf_dir).rects.repartitionByRange("t1")
    rows = order.rectangle_sort(rects).select("t1", "t2", "s", "t", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    key = F.struct(F.col("t1"), -F.col("t2"), F.col("s"), -F.col("t"))
    before = F.lag(key).over(model.Window.partitionBy("p").orderBy("i"))
    return stored(rows, "sorted").select(key.alias("k"), before.alias("b")).agg(F.count("*").alias("n"), F.count_if(F.col("k") < F.col("b")).alias("n_wrong"))


def merged_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred edges of the merge of two canonically sorted halves of the graph, with their places."""
    edges = stored(graphs.trade(spark, sf_dir), "trade")
    halves = [order.canonical_sort(edges.where(F.col("src") % 2 == k)) for k in (0, 1)]
    return order.merge_sorted(*halves).limit(100)


def first_and_last_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five first and five last windows."""
    ends = windows.preview(_windows(spark))
    rows = [(name, r["window_id"], r["ts"], r["te"]) for name, found in zip(("first", "last"), ends, strict=True) for r in found]
    return spark.createDataFrame(rows, "side string, window_id bigint, ts int, te int")


def sliding_window_msf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding.sliding_forest(_local(spark, sf_dir), 4, QUARTERS).select("te", "src", "dest", "weight", "ts")


def _stream(edges: DataFrame) -> DataFrame:
    """All edges as a stream, one graph for each destination's parity."""
    seq = F.row_number().over(model.Window.partitionBy("graph_id").orderBy("ts", "weight", "src", "dest")).cast("bigint")
    return edges.withColumn("graph_id", (F.col("dest") % 2).cast("bigint")).select("graph_id", seq.alias("seq"), F.col("ts").alias("t"), "src", "dest", "weight")


def _thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stream's edges that may be in a forest while a window of four quarters slides over them, and counts of the others."""
    edges = stored(graphs.trade(spark, sf_dir).withColumn("graph_id", (F.col("dest") % 2).cast("bigint")), "trade")
    return stored(dynamic.thin(edges, 4, NATIONS), "thinned")


def dynamic_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result codes of a replay of the whole edge stream in which edges slide out after four quarters."""
    thinned = _thinned(spark, sf_dir)
    made = dynamic.replay(dynamic.sliding_operations(dynamic.events_of(thinned), 4), NATIONS)
    return dynamic.code_counts(made).unionByName(dynamic.idle_counts(thinned)).groupBy("op", "code").agg(F.sum("n").alias("n"))


def dynamic_forest_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and weight of each graph's forest at the end of each quarter, added up from what the replay's operations put in and took out.

    An edge that goes in joins the forest unless it is rejected, and one that goes out leaves it
    if the forest changes; the edge in the operation's answer goes the other way.
    """
    # the edges left out are in no forest; the first of each quarter stays, so no quarter is lost
    operations = stored(dynamic.sliding_operations(dynamic.events_of(_thinned(spark, sf_dir)), 4), "operations")
    made = dynamic.replay(operations, NATIONS).select("graph_id", "seq", "code", F.col("weight").alias("other"))
    both = operations.join(made, ["graph_id", "seq"])
    sign = F.when(F.col("op") == "insert", 1).otherwise(-1)
    size = F.when(F.col("code") == dynamic.STRUCTURAL, sign).otherwise(0)
    moved = sign * F.when(F.col("code") == dynamic.UNCHANGED, 0).otherwise(F.col("weight") - F.coalesce("other", F.lit(0)))
    # evictions follow the first event of the quarter that causes them
    now = F.max(F.when(F.col("op") == "insert", F.col("ts"))).over(model.Window.partitionBy("graph_id").orderBy("seq"))
    each = both.select("graph_id", now.alias("te"), size.alias("size"), moved.cast("bigint").alias("moved")).groupBy("graph_id", "te").agg(F.sum("size").alias("size"), F.sum("moved").alias("moved"))
    so_far = model.Window.partitionBy("graph_id").orderBy("te")
    return each.select("graph_id", "te", F.sum("size").over(so_far).alias("n_edges"), F.sum("moved").over(so_far).alias("total_weight"))


def sliding_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dynamic.sliding_operations(_stream(graphs.trade(spark, sf_dir)), 4)
    return found.groupBy("graph_id", "op", "ts").agg(F.count("*").alias("n"), F.sum("weight").alias("sum_weight"))


def reinsert_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest's weight with all undirected edges, without a sample of them, and when the sample is back."""
    edges = stored(model.undirected(graphs.trade(spark, sf_dir)).select(*model.EDGE).distinct(), "undirected")
    return dynamic.reinsert_sample(edges, order.systematic_sample(edges, 60), NATIONS)


def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.systematic_sample(graphs.trade(spark, sf_dir), 100)


def simple_lightest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.lightest(graphs.trade(spark, sf_dir))


def adjacency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree and least weight of every vertex in the symmetric adjacency."""
    return model.adjacency(graphs.trade(spark, sf_dir)).groupBy("src").agg(F.count("*").alias("degree"), F.min("weight").alias("least"))


def bipartite_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graphs.supply(spark, sf_dir)
    n1 = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg((F.max("l_suppkey") + 1).cast("int").alias("n1"))
    plain = rows.crossJoin(F.broadcast(n1)).select("src", (F.col("dest") - F.col("n1")).alias("dest"), F.col("ts").alias("t"), "weight")  # one row
    return files.event_stream(plain, bipartite=True).select("t", "weight", "src", F.col("dest").cast("int").alias("dest"))


def undirected_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.unweighted(graphs.session(spark, sf_dir)).select("src", "dest")


def time_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last timestamp and a tenth of the extent."""
    return graphs.session(spark, sf_dir).agg(F.min("ts").alias("t_min"), F.max("ts").alias("t_max"), F.floor((F.max("ts") - F.min("ts")) * 10 / 100).cast("int").alias("width"))


def session_local_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and weight of the forest of every day of the event graph."""
    return forest.weight_by_key(forest.local_forest(graphs.session(spark, sf_dir)), "ts")


def supply_local_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and weight of the forest of every month of the supply graph."""
    return forest.weight_by_key(forest.local_forest(graphs.supply(spark, sf_dir)), "ts")


def forest_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths of the trees of every timestamp's forest, rooted at the smallest vertex."""
    return forest.forest_depth(_local(spark, sf_dir).withColumn("k", F.col("ts")), "k").select(F.col("k").cast("int").alias("ts"), "max_depth", "avg_depth")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        graph_stats, edges_per_timestamp, snapshot_window, timestamp_point_scan, base_stream_split, generate_windows, first_and_last_windows, canonical_ranks, time_sorted, merged_order, local_forest,
        window_msf_online, window_msf_kway, msf_whole_graph, msf_boruvka, msf_weight_by_window, msf_components_by_window, msf_rejected_edges,
        staircase_records, staircase_parallel, staircase_incremental, expiry_rectangles, appended_rectangles, sorted_rectangles, mean_lifetime, mean_t_per_s, segment_nodes, quad_cover_histogram,
        record_validity, rectangle_relations, strategy_agreement, saved_staircase, index_tables, sliding_window_msf, dynamic_codes, dynamic_forest_by_quarter, sliding_operations, reinsert_sample,
        systematic_sample, simple_lightest_edges, adjacency_lists, bipartite_stream, undirected_distinct, undirected_weights, time_extent, session_local_forest, supply_local_forest, forest_depth,
        file_text_graph, file_binary_graph, file_binary_windows, file_binary_stream, file_stream_source, file_loose_edges, file_loose_temporal, file_road, file_adjacency, file_histogram,
    )
} | {f"window_msf_{s}": _by(s) for s in INDEXED} | {f"saved_index_{s}": saved_index(s) for s in INDEXED}


_TRADE = """trade as (
  select distinct cast(s_nationkey as int) as src, cast(c_nationkey as int) as dest, cast(floor(l_extendedprice) as int) as weight,
    cast(year(l_shipdate) * 4 + quarter(l_shipdate) - (1995 * 4 + 1) as int) as ts
  from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  where s_nationkey <> c_nationkey)"""
_SIZE = int((QUARTERS - 1) * RATIO)
_WINDOWS = f"""w as (
  select range as window_id, cast(range * 7 % {QUARTERS - _SIZE} as int) as ts, cast(range * 7 % {QUARTERS - _SIZE} + {_SIZE} as int) as te from range({COUNT}))"""


def _msf(name: str, source: str, n: int | str = NATIONS) -> str:
    """CTEs that end in ``name`` (k, src, dest, weight, ts): Kruskal over ``source``'s edges for each k, with labels in a list."""
    return f"""{name}_r as (
  select *, row_number() over (partition by k order by weight, ts desc, src, dest) as rn from ({source})),
{name}_l as (
  select k, list_reduce(list({{'u': src, 'v': dest, 'rn': rn}} order by rn), lambda st, x:
    case when st.lab[x.u + 1] = st.lab[x.v + 1] then st else
      {{'lab': list_transform(st.lab, lambda y: case when y = st.lab[x.v + 1] then st.lab[x.u + 1] else y end), 'picked': list_append(st.picked, x.rn)}} end,
    {{'lab': range({n}), 'picked': []::bigint[]}}).picked as picked from {name}_r group by k),
{name}_p as (select k, unnest(picked) as rn from {name}_l),
{name} as (select k, src, dest, weight, ts from {name}_p join {name}_r using (k, rn))"""


_LOCAL = f"{_TRADE},\n{_msf('lf', 'select ts as k, * from trade')}"
_ONLINE = f"{_LOCAL},\n{_WINDOWS},\n{_msf('msf', 'select window_id as k, lf.src, lf.dest, lf.weight, lf.ts from w join lf on lf.ts between w.ts and w.te')}"
_STAIRS = f"""{_LOCAL},
pairs as (select a.range as a, b.range as b from range({QUARTERS}) as a, range({QUARTERS}) as b where a.range <= b.range),
{_msf('af', f'select a * {QUARTERS} + b as k, lf.src, lf.dest, lf.weight, lf.ts from pairs join lf on lf.ts between a and b')},
ends as (select lf.*, b.range as te from lf, range({QUARTERS}) as b where b.range >= lf.ts),
least as (select src, dest, weight, ts, k % {QUARTERS} as te, min(k // {QUARTERS}) as a from af group by all),
sv as (
  select ends.src, ends.dest, ends.weight, ends.ts as t, ends.te, coalesce(least.a - 1, ends.ts) as s
  from ends left join least using (src, dest, weight, ts, te)),
steps as (
  select src, dest, weight, t, cast(s as int) as s, cast(te as int) as te_from
  from (select *, lag(s) over (partition by src, dest, weight, t order by te) as before from sv) where before is null or s > before),
rects as (
  select src, dest, weight, t, s, te_from as t1, coalesce(lead(te_from) over (partition by src, dest, weight, t order by te_from), {model.OPEN}) as t2 from steps)"""
_MSF = f"with {_ONLINE} select k as window_id, src, dest, weight, ts from msf"
_STEPS = f"with {_STAIRS} select * from steps"
_SUPPLY = """n1 as (select max(l_suppkey) + 1 as n1 from lineitem),
supply as (
  select distinct cast(l_suppkey as int) as src, cast(n1 + l_partkey as int) as dest, cast(floor(l_extendedprice) as int) as weight,
    cast(year(l_shipdate) * 12 + month(l_shipdate) - (1995 * 12 + 1) as int) as ts from lineitem, n1)"""
_SESSION = """ev as (
  select user_id, value, cast(ts as date) as day, lag(user_id) over (partition by cast(ts as date) order by ts, event_id) as before from events),
session as (
  select distinct cast(before as int) as src, cast(user_id as int) as dest, cast(floor(value * 100) as int) as weight,
    cast(datediff('day', (select min(cast(ts as date)) from events), day) as int) as ts
  from ev where before is not null and before <> user_id)"""

ORACLE_SQL: dict[str, str] = {
    "graph_stats": f"with {_TRADE} select greatest(max(src), max(dest)) + 1 as n, count(*) as m, max(ts) + 1 as t_count from trade",
    "edges_per_timestamp": f"with {_TRADE} select ts, count(*) as n_edges from trade group by ts",
    "snapshot_window": f"with {_TRADE} select * from trade where ts between 4 and 6",
    "timestamp_point_scan": f"with {_TRADE} select * from trade where ts = 5",
    "base_stream_split": f"with {_TRADE}, c as (select max(ts) + 1 as t from trade) select cast(floor(t * 0.8) as int) as n_base, cast(t - floor(t * 0.8) as int) as n_stream from c",
    "generate_windows": f"with {_WINDOWS} select * from w",
    "canonical_ranks": f"with {_TRADE} select *, cast(row_number() over (partition by ts order by weight, src, dest) as int) as rank from trade",
    "local_forest": f"with {_LOCAL} select src, dest, weight, ts from lf",
    "msf_boruvka": f"with {_LOCAL} select src, dest, weight, ts from lf",
    "msf_whole_graph": f"with {_LOCAL}, {_msf('msf', 'select 0 as k, src, dest, weight, ts from lf')} select src, dest, weight, ts from msf",
    "msf_weight_by_window": f"with {_ONLINE} select k as window_id, cast(sum(weight) as bigint) as total_weight, count(*) as n_edges from msf group by k",
    "msf_components_by_window": f"with {_ONLINE} select window_id, {NATIONS} - count(msf.k) as n_components from w left join msf on k = window_id group by window_id",
    "msf_rejected_edges": f"""with {_LOCAL}, {_msf('msf', 'select 0 as k, src, dest, weight, ts from lf')}
select src, dest, weight, ts from trade except select src, dest, weight, ts from msf""",
    "staircase_records": _STEPS,
    "staircase_parallel": _STEPS,
    "staircase_incremental": _STEPS,
    "expiry_rectangles": f"with {_STAIRS} select * from rects where s < t",
    "mean_lifetime": f"""with {_STAIRS}, last as (select t, arg_max(s, te_from) as s, max(te_from) as te from steps group by src, dest, weight, t)
select avg(case when s = t then te - t else {QUARTERS} - t end) as mean_lifetime from last""",
    "mean_t_per_s": f"with {_STAIRS} select avg(k) as mean_t_per_s from (select count(distinct t) as k from rects group by t1, t2, s)",
    "segment_nodes": f"""with {_STAIRS}, d as (
  select l.range as level, (t1 + (1 << l.range) - 1) // (1 << l.range) as a, least(t2, 32) // (1 << l.range) as b from rects, range(6) as l where s < t),
n as (select level, a as pos from d where a < b and a % 2 = 1 union all select level, b - 1 from d where a < b and b % 2 = 1)
select cast(level as int) as level, cast(pos as int) as pos, count(*) as n_rects from n group by level, pos""",
    "quad_cover_histogram": f"""with {_STAIRS}, r as (
  select row_number() over () as id, t1 as x1, least(t2, 32) as x2, s + 1 as y1, t + 1 as y2 from rects where s < t),
box as (
  select id, l.range as level, greatest(0, (x2 // (1 << l.range)) - ((x1 + (1 << l.range) - 1) // (1 << l.range))) as nx,
    greatest(0, (y2 // (1 << l.range)) - ((y1 + (1 << l.range) - 1) // (1 << l.range))) as ny from r, range(6) as l),
whole as (select id, level, nx * ny as cells from box),
own as (select a.id, sum(a.cells - coalesce(4 * b.cells, 0)) as n_cells from whole as a left join whole as b on a.id = b.id and b.level = a.level + 1 group by a.id)
select cast(n_cells as bigint) as n_cells, count(*) as n_rects from own group by 1""",
    "strategy_agreement": f"""with {_ONLINE}
select k as window_id, count(*) as n_left, count(*) as n_right, count(*) as n_both, cast(sum(weight) as bigint) as weight_left, cast(sum(weight) as bigint) as weight_right from msf group by k""",
    "saved_staircase": _STEPS,
    "index_tables": f"""with {_STAIRS},
live as (select src, dest, weight, t, s, t1, t2 from rects where s < t),
d as (
  select (a1 + (1 << l.range) - 1) // (1 << l.range) as a, b1 // (1 << l.range) as b, kind
  from (select 'rect_nodes' as kind, t1 as a1, least(t2, 32) as b1 from live union all select 'rect_start_nodes', s + 1, t + 1 from live), range(6) as l),
box as (
  select row_number() over () as id, t1 as x1, least(t2, 32) as x2, s + 1 as y1, t + 1 as y2 from live),
whole as (
  select id, l.range as level, greatest(0, x2 // (1 << l.range) - (x1 + (1 << l.range) - 1) // (1 << l.range))
    * greatest(0, y2 // (1 << l.range) - (y1 + (1 << l.range) - 1) // (1 << l.range)) as cells from box, range(6) as l),
own as (select sum(a.cells - coalesce(4 * b.cells, 0)) as n from whole as a left join whole as b on a.id = b.id and b.level = a.level + 1)
select 'staircase' as name, count(*) as n_rows from steps union all select 'rects', count(*) from live
union all select kind, cast(sum(cast(a < b and a % 2 = 1 as int) + cast(a < b and b % 2 = 1 as int)) as bigint) from d group by kind
union all select 'rect_cells', cast(n as bigint) from own""",
    "appended_rectangles": f"with {_STAIRS} select * from rects where s < t",
    "sorted_rectangles": f"with {_STAIRS} select count(*) as n, 0::bigint as n_wrong from rects where s < t",
    "record_validity": f"with {_ONLINE} select k as window_id, count(*) as n_edges from msf group by k",
    "rectangle_relations": f"""with {_STAIRS}, r as (select *, least(t2, {QUARTERS}) as e from rects where s < t),
m as (select *, greatest(t1, 5) as x1, least(e, 15) as x2, greatest(s, 3) as y1, least(t, 12) as y2 from r)
select src, dest, weight, t, t1, t1 <= 15 and e >= 5 and s <= 12 and t >= 3 as touches, e <= t1 or t <= s as is_empty,
  case when x1 < x2 and y1 < y2 then x1 end as x1, case when x1 < x2 and y1 < y2 then x2 end as x2,
  case when x1 < x2 and y1 < y2 then y1 end as y1, case when x1 < x2 and y1 < y2 then y2 end as y2,
  greatest(t1, 5) < least(e, 15) as line_touches, case when greatest(t1, 5) < least(e, 15) then least(e, 15) end as line_end, t1 = e as line_is_empty
from m""",
    "first_and_last_windows": f"""with {_WINDOWS}
select case when window_id < 5 then 'first' else 'last' end as side, * from w where window_id < 5 or window_id >= {COUNT - 5}""",
    "time_sorted": f"with {_TRADE} select ts, count(*) as n_edges, 1::bigint as n_parts from trade group by ts",
    "merged_order": f"with {_TRADE} select * from trade order by weight, ts desc, src, dest limit 100",
    "dynamic_forest_by_quarter": f"""with {_TRADE}, w as (select g.range as g, te.range as te from range(2) as g, range({QUARTERS}) as te),
{_msf('part', 'select dest % 2 * 100 + ts as k, src, dest, weight, ts from trade')},
{_msf('msf', 'select g * 100 + te as k, part.src, part.dest, part.weight, part.ts from w join part on dest % 2 = g and ts between te - 4 and te')}
select cast(k // 100 as bigint) as graph_id, cast(k % 100 as int) as te, count(*) as n_edges, cast(sum(weight) as bigint) as total_weight from msf group by k""",
    "sliding_window_msf": f"""with {_LOCAL}, w as (select range as te from range({QUARTERS})),
{_msf('msf', 'select te as k, lf.src, lf.dest, lf.weight, lf.ts from w join lf on lf.ts between te - 4 and te')}
select cast(k as int) as te, src, dest, weight, ts from msf""",
    "sliding_operations": f"""with {_TRADE}, e as (select dest % 2 as graph_id, * from trade),
m as (select graph_id, max(ts) as last from e group by graph_id)
select cast(graph_id as bigint) as graph_id, 'insert' as op, ts, count(*) as n, cast(sum(weight) as bigint) as sum_weight from e group by all
union all select cast(graph_id as bigint), 'delete', ts, count(*), cast(sum(weight) as bigint) from e join m using (graph_id) where ts + 4 < last group by all""",
    "reinsert_sample": f"""with {_TRADE}, o as (select distinct least(src, dest) as src, greatest(src, dest) as dest, weight, ts from trade),
placed as (select *, row_number() over (order by src, dest, weight, ts) - 1 as i, greatest(1, count(*) over () // 60) as step from o),
marked as (select src, dest, weight, ts, i % step = 0 and i < step * 60 as sampled from placed),
{_msf('lf', 'select ts as k, src, dest, weight, ts from marked')},
{_msf('lr', 'select ts as k, src, dest, weight, ts from marked where not sampled')},
{_msf('every', 'select 0 as k, src, dest, weight, ts from lf')},
{_msf('less', 'select 0 as k, src, dest, weight, ts from lr')},
a as (select cast(sum(weight) as bigint) as x from every), b as (select cast(sum(weight) as bigint) as x from less)
select a.x as before, b.x as without, a.x as after, (select count(*) from marked where sampled) as n_sampled from a, b""",
    "systematic_sample": f"""with {_TRADE}, o as (select distinct least(src, dest) as src, greatest(src, dest) as dest, weight, ts from trade),
n as (select *, row_number() over (order by src, dest, weight, ts) - 1 as i, greatest(1, count(*) over () // 100) as step from o)
select src, dest, weight, ts from n where i % step = 0 and i < step * 100""",
    "simple_lightest_edges": f"with {_TRADE} select least(src, dest) as src, greatest(src, dest) as dest, min(weight) as weight from trade group by 1, 2",
    "adjacency_lists": f"""with {_TRADE}, o as (select least(src, dest) as a, greatest(src, dest) as b, min(weight) as w from trade group by 1, 2),
s as (select a as src, w from o union all select b, w from o) select src, count(*) as degree, min(w) as least from s group by src""",
    "bipartite_stream": f"with {_SUPPLY} select ts as t, weight, src, dest from supply",
    "undirected_distinct": f"with {_SESSION} select distinct least(src, dest) as src, greatest(src, dest) as dest from session",
    "undirected_weights": f"with {_SESSION}, p as (select distinct least(src, dest) as src, greatest(src, dest) as dest from session) select count(*) as n, count(*) as n_in_range, count(*) as n_equal from p",
    "session_local_forest": f"""with {_SESSION}, {_msf('msf', 'select ts as k, src, dest, weight, ts from session', '(select max(greatest(src, dest)) + 1 from session)')}
select cast(k as int) as ts, cast(sum(weight) as bigint) as total_weight, count(*) as n_edges from msf group by k""",
    "supply_local_forest": f"""with {_SUPPLY}, {_msf('msf', 'select ts as k, src, dest, weight, ts from supply', '(select max(dest) + 1 from supply)')}
select cast(k as int) as ts, cast(sum(weight) as bigint) as total_weight, count(*) as n_edges from msf group by k""",
    "forest_depth": f"""with recursive {_LOCAL},
pairs as (select ts, src as a, dest as b from lf union all select ts, dest, src from lf),
reach as (select distinct ts, a as v, a as r from pairs union select reach.ts, b, r from reach join pairs on reach.ts = pairs.ts and a = v),
roots as (select ts, v, min(r) as r from reach group by ts, v),
walk as (
  select ts, v, -1 as up, 0 as depth from roots where v = r
  union all select walk.ts, b, v, depth + 1 from walk join pairs on walk.ts = pairs.ts and a = v where b <> up)
select ts, cast(max(depth) as int) as max_depth, avg(depth) as avg_depth from walk group by ts""",
    "file_text_graph": f"with {_TRADE} select * from trade",
    "file_binary_graph": f"with {_TRADE} select * from trade",
    "file_binary_windows": f"with {_WINDOWS} select ts, te from w",
    "file_binary_stream": f"with {_TRADE} select ts as t, weight, src, dest from trade",
    "file_stream_source": f"with {_TRADE} select ts as t, weight, src, dest from trade",
    "file_loose_edges": f"with {_TRADE} select src, dest, weight from trade",
    "file_loose_temporal": f"with {_TRADE} select src, dest, cast(ts as bigint) as t from trade",
    "file_road": f"with {_TRADE} select src, dest, weight from trade where ts % 7 <> 0 and src < dest",
    "file_adjacency": f"""with {_TRADE}, s as (select src, dest, weight from trade union all select dest, src, weight from trade)
select src, dest, count(*) as n, cast(sum(weight) as bigint) as sum_weight from s group by src, dest""",
    "time_extent": f"with {_SESSION} select min(ts) as t_min, max(ts) as t_max, cast((max(ts) - min(ts)) * 10 // 100 as int) as width from session",
} | {f"window_msf_{s}": _MSF for s in ("online", "kway", *INDEXED)} | {f"saved_index_{s}": _MSF for s in INDEXED}
ORACLE_SQL["file_histogram"] = ORACLE_SQL["quad_cover_histogram"]
