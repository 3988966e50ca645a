import numpy as np
import pytest
from conftest import rows
from graphs_by_hand import M1

from sylva.functions import geometry
from sylva.sources import files

E = "src int, dest int, weight int, ts int"


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def i4(*x):
    return np.array(x, "<i4").tobytes()


def test_binary_formats(spark, tmp_path):
    graph = files.binary_graph(np.array(M1))
    assert rows(files.read_binary_graph(spark, write(tmp_path / "g.bin", graph))) == sorted(M1, key=repr)
    with pytest.raises(Exception, match="ends before"):
        files.read_binary_graph(spark, write(tmp_path / "cut.bin", graph[:-4])).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_binary_graph(spark, str(tmp_path / "none.bin")).collect()
    windows = np.array([2], "<u8").tobytes() + i4(0, 3, 1, 2)
    assert rows(files.read_binary_windows(spark, write(tmp_path / "w.bin", windows)).select("ts", "te")) == [(0, 3), (1, 2)]
    stream = i4(4) + np.array([2], "<i8").tobytes() + i4(0, 9, 1, 2, 5, 8, 0, 3)
    assert rows(files.read_binary_stream(spark, write(tmp_path / "s.stream", stream))) == [(0, 9, 1, 2), (5, 8, 0, 3)]
    adjacency = i4(2, 3, 1) + i4(1, 5, 1, 6, 1, 7, 0, 5)  # a degree above the number of vertices
    assert rows(files.read_binary_adjacency(spark, write(tmp_path / "d.bin", adjacency))) == [(0, 1, 5), (0, 1, 6), (0, 1, 7), (1, 0, 5)]


def test_written_binary_files_and_stream(spark, tmp_path):
    df = spark.createDataFrame(M1, E).repartition(3)
    files.write_binary_graph(df, str(tmp_path / "graph"))
    assert rows(files.read_binary_graph(spark, str(tmp_path / "graph"))) == sorted(M1, key=repr)
    files.write_binary_graph(df.limit(0), str(tmp_path / "empty"))
    assert list((tmp_path / "empty").iterdir()) == []
    files.write_binary_graph(df, str(tmp_path / "graph"))
    assert rows(files.read_binary_graph(spark, str(tmp_path / "graph"))) == sorted(M1 * 2, key=repr)
    events = df.selectExpr("ts as t", "weight", "src", "dest")
    files.write_binary_stream(events, str(tmp_path / "events"), 4)
    assert rows(files.read_binary_stream(spark, str(tmp_path / "events"))) == rows(events)
    query = files.stream_events(spark, str(tmp_path / "events")).writeStream.format("memory").queryName("events_read").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert rows(spark.table("events_read")) == rows(events) and len(query.recentProgress) >= len(list((tmp_path / "events").iterdir()))


def test_text_graph_round_trip_and_bad_lines(spark, tmp_path):
    files.write_text_graph(spark.createDataFrame(M1, E), str(tmp_path / "out"))
    assert rows(files.read_text_graph(spark, str(tmp_path / "out"))) == sorted(M1, key=repr)
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        files.read_text_graph(spark, write(tmp_path / "bad.txt", "1 2 x 4\n")).collect()


def test_loose_edge_lists(spark, tmp_path):
    path = write(tmp_path / "e.txt", "# 1 2\n1 2 7.5 100\n2,3,8,101\nx 4 5 6\n5 6\n\n7\t8\t9\t102\n")
    assert files.token_count(spark, path) == 2
    assert rows(files.read_loose_edges(spark, path, 4)) == [(1, 2, 7), (2, 3, 8), (7, 8, 9)]
    assert rows(files.read_loose_temporal(spark, path, 4)) == [(1, 2, 100), (2, 3, 101), (7, 8, 102)]
    assert rows(files.read_loose_edges(spark, path)) == [(5, 6, 1)]
    road = write(tmp_path / "road.gr", "c 1 2 3\na 1 2 30\na 2 1 30\na 3 2 4\na 2 3 4\n")
    assert rows(files.read_road(spark, road)) == [(1, 2, 30), (2, 3, 4)]


def test_preprocessing(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (2, 5)], "src int, dest int")
    found = files.unweighted(pairs, weights=10)
    assert [(r.src, r.dest) for r in found.orderBy("src", "dest").collect()] == [(1, 2), (2, 5)]
    assert all(1 <= r.weight <= 10 for r in found.collect()) and rows(found) == rows(files.unweighted(pairs, weights=10))
    temporal = spark.createDataFrame([(0, 0, 5, 3), (1, 0, 5, 3), (1, 0, 5, 3), (0, 1, 1, 4)], "src int, dest int, t int, weight int")
    assert rows(files.event_stream(temporal, bipartite=True)) == [(1, 4, 0, 3), (5, 3, 0, 2), (5, 3, 1, 2)]
    assert rows(files.dense_times(temporal).select("t", "ts").distinct()) == [(1, 0), (5, 1)]


def test_adjacency_and_windows_files(spark, tmp_path):
    df = spark.createDataFrame(M1, E)
    files.write_adjacency(df, str(tmp_path / "adjacency"))
    found = rows(spark.read.parquet(str(tmp_path / "adjacency")))
    assert (0, 3, 2) in found and (3, 0, 2) in found and len(found) == 12
    w = spark.createDataFrame([(0, 1, 2)], "window_id bigint, ts int, te int")
    files.write_windows(w, str(tmp_path / "w"))
    assert rows(files.read_windows(spark, str(tmp_path / "w"))) == [(0, 1, 2)]
    files.write_histogram(spark.createDataFrame([(2, 5), (1, 3)], "n int, k int"), str(tmp_path / "h"))
    assert [r.value for r in spark.read.text(str(tmp_path / "h")).collect()] == ["1 3", "2 5"]


def test_geometry(spark):
    box = "struct<x1:int,x2:int,y1:int,y2:int>"
    df = spark.createDataFrame([((0, 2, 0, 2), (1, 3, 1, 3)), ((0, 2, 0, 2), (2, 3, 0, 1)), ((0, 1, 0, 1), (5, 6, 5, 6))], f"a {box}, b {box}")
    found = df.select(geometry.intersects("a", "b").alias("t"), geometry.intersection("a", "b").alias("i"), geometry.is_empty("a").alias("e")).collect()
    assert [r.t for r in found] == [True, True, False]
    assert found[0].i == (1, 2, 1, 2) and found[1].i is None and not found[0].e
    line = spark.createDataFrame([((3, 0), (2, 5)), ((0, 1), (1, 2)), ((4, 4), (0, 9))], "a struct<x1:int,x2:int>, b struct<x1:int,x2:int>")
    found = line.select(geometry.line_intersects("a", "b").alias("t"), geometry.line_intersection("a", "b").alias("i"), geometry.line_is_empty("a").alias("e")).collect()
    assert [(r.t, r.i and tuple(r.i), r.e) for r in found] == [(True, (2, 3), False), (False, None, False), (False, None, True)]
    record = spark.createDataFrame([([(-1, 1), (0, 3)], 1, 2), ([(-1, 1), (0, 3)], 0, 3), ([(-1, 1)], 0, 0)], "r array<struct<s:int,te_from:int>>, ts int, te int")
    assert [r[0] for r in record.select(geometry.valid_record(record.r, record.ts, record.te)).collect()] == [True, False, False]
