import datetime
import random

import pytest
from conftest import rows
from graphs_by_hand import kruskal, random_graph, window
from pyspark.sql import Window
from pyspark.sql import functions as F

from sylva import queries
from sylva.functions.order import systematic_sample
from sylva.operators.staircase import rectangles, staircase
from sylva.streaming import dynamic, sliding

SCHEMA = "src int, dest int, weight int, ts int"


@pytest.mark.parametrize("base", [0, 1, 4])
def test_appending_equals_building(spark, base):
    _, total, edges = random_graph(5)
    df = spark.createDataFrame(edges, SCHEMA)
    assert rows(sliding.incremental_staircase(df, min(base, total), total, batch=2)) == rows(staircase(df, t_total=total))


def test_appended_rectangles_leave_closed_ones_alone(spark):
    _, total, edges = random_graph(5)
    df = spark.createDataFrame(edges, SCHEMA)
    whole, half = staircase(df, t_total=total), total // 2
    before = staircase(df.where(f"ts < {half}"), t_total=half)
    now = rectangles(before)
    closed, open_ = sliding.append_rectangles(now.where(f"t2 = {2**31 - 1}"), whole.where(f"te_from >= {half}"))
    assert rows(now.where(f"t2 < {2**31 - 1}").unionByName(closed).unionByName(open_).where("s < t")) == rows(rectangles(whole))


@pytest.mark.parametrize("width", [0, 2, 100])
def test_sliding_forest(spark, width):
    _, total, edges = random_graph(2)
    df = spark.createDataFrame(edges, SCHEMA)
    expected = [(0, te, *e) for te in range(total) for e in window(edges, te - width, te)]
    assert rows(sliding.sliding_forest(df, width, total)) == sorted(expected, key=repr)


def test_sliding_forest_over_a_stream(spark, tmp_path):
    r = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    origin = int(start.replace(tzinfo=datetime.timezone.utc).timestamp())
    events = sorted({(r.randrange(6), r.randrange(6), r.randrange(4), t) for t in (0, 0, 1, 1, 2, 5, 5, 6, 8, 8, 9) for _ in range(3)}, key=lambda e: e[3])
    total = 10
    for k, part in enumerate((events[: len(events) // 2], events[len(events) // 2 :], [(0, 1, 1, total)])):
        frame = [(0, start + datetime.timedelta(seconds=60 * t + 5), s, d, w) for s, d, w, t in part]
        spark.createDataFrame(frame, "graph_id bigint, event_time timestamp, src int, dest int, weight int").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("graph_id bigint, event_time timestamp, src int, dest int, weight int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    made = sliding.sliding_stream(stream, 2, 60, origin)
    running = made.writeStream.format("memory").queryName("forests").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    found = {tuple(x)[1:] for x in spark.table("forests").collect()}
    assert found == {(te, *e) for te in range(total) for e in window(events, te - 2, te)}


def test_maintained_index(spark, tmp_path):
    _, total, edges = random_graph(5)
    bounds = [0, 2, 3, total]
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        spark.createDataFrame([e for e in edges if a <= e[3] < b], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    sliding.maintain(stream, str(tmp_path / "index"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    steps = spark.read.parquet(str(tmp_path / "index/steps")).select("src", "dest", "weight", "t", "s", "te_from")
    assert rows(steps) == rows(staircase(spark.createDataFrame(edges, SCHEMA), t_total=total))


def test_replay_of_a_sliding_window(spark):
    _, total, edges = random_graph(5)
    edges = [e for e in sorted(edges, key=lambda e: e[3]) if e[0] != e[1]]
    events = spark.createDataFrame([(0, i, e[3], e[0], e[1], e[2]) for i, e in enumerate(edges)], "graph_id bigint, seq bigint, t int, src int, dest int, weight int")
    operations = dynamic.sliding_operations(events, 2)
    there, live = [], set()
    for r in sorted(operations.collect(), key=lambda r: r.seq):
        e = (r.src, r.dest, r.weight, r.ts)
        (live.add if r.op == "insert" else live.discard)(e)
        there.append(set(live))
    assert there[-1] == {e for e in edges if e[3] >= edges[-1][3] - 2}
    codes = dynamic.replay(operations, 8)
    assert codes.count() == operations.count() and codes.where("code = -1").count() == 0
    drained = dynamic.replay(dynamic.sliding_operations(events, 2, drain=True), 8)
    assert drained.where("op = 'delete'").count() == len(edges)


def test_reinserted_sample_changes_nothing(spark):
    n, _, edges = random_graph(5)
    df = spark.createDataFrame([(min(a, b), max(a, b), w, t) for a, b, w, t in edges if a != b], SCHEMA).distinct()
    out = dynamic.reinsert_sample(df, systematic_sample(df, 5), n).first()
    every, some = {tuple(r) for r in df.collect()}, {tuple(r) for r in systematic_sample(df, 5).collect()}
    weight = lambda edges: sum(e[2] for e in kruskal(edges))
    assert tuple(out) == (weight(every), weight(every - some), weight(every), 5)


def test_sliding_operations_are_a_sort(spark):
    events = spark.range(20_000).selectExpr("0L as graph_id", "id as seq", "cast(id / 7 as int) as t", "0 as src", "1 as dest", "1 as weight")
    made = dynamic.sliding_operations(events, 50)
    found = {(r.op, r.n) for r in made.groupBy("op").count().withColumnRenamed("count", "n").collect()}
    last = (20_000 - 1) // 7
    assert found == {("insert", 20_000), ("delete", sum(i // 7 + 50 < last for i in range(20_000)))}
    assert "unboundedfollowing" not in made._jdf.queryExecution().optimizedPlan().toString().lower().split("min(seq")[1][:200]


@pytest.mark.parametrize("width", [0, 2, 4, 100])
def test_thinned_streams_have_the_codes_of_whole_ones(spark, width):
    r = random.Random(width)
    times = [0, 1, 2, 3, 4, 7, 8, 15, 16, 17, 18, 19, 40]
    edges = sorted({(r.randrange(5), r.randrange(6), r.randrange(40), t, g) for g in (3, 8) for t in times[g % 2 :] for _ in range(40)})
    edges = spark.createDataFrame(edges, "src int, dest int, weight int, ts int, graph_id bigint")  # loops, and ids beyond n = 5
    seq = F.row_number().over(Window.partitionBy("graph_id").orderBy("ts", "weight", "src", "dest")).cast("bigint")
    whole = edges.select("graph_id", seq.alias("seq"), F.col("ts").alias("t"), "src", "dest", "weight")
    expected = rows(dynamic.code_counts(dynamic.replay(dynamic.sliding_operations(whole, width), 5)))
    thinned = dynamic.thin(edges, width, 5).persist()
    made = dynamic.code_counts(dynamic.replay(dynamic.sliding_operations(dynamic.events_of(thinned), width), 5))
    assert rows(made.unionByName(dynamic.idle_counts(thinned)).groupBy("op", "code").agg(F.sum("n").alias("n"))) == expected
    left = thinned.where("not idle").count()
    assert left < edges.count() if 0 < width < 100 else left <= edges.count()


def test_a_thinned_stream_is_small(spark):
    edges = queries.graphs.trade(spark, "/root/testdata/sf0.01").withColumn("graph_id", (F.col("dest") % 2).cast("bigint"))
    assert dynamic.thin(edges, 4, queries.NATIONS).where("not idle").count() < edges.count() / 5
