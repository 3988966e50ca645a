import pytest
from conftest import rows
from graphs_by_hand import M1, M1_WEIGHTS, M3, M4, kruskal, random_graph, window

from sylva import model
from sylva.operators import forest, staircase
from sylva.plans import index, query, windows

SCHEMA = "src int, dest int, weight int, ts int"


def table(spark, edges):
    return spark.createDataFrame(edges, SCHEMA)


@pytest.mark.parametrize("seed", [2, 5])
def test_all_strategies_equal_brute_force(spark, seed):
    _, total, edges = random_graph(seed)
    df = table(spark, edges)
    asked = windows.all_windows(spark, total)
    built = query.Index(staircase.rectangles(staircase.staircase(df, 3, t_total=total)), total)
    expected = sorted(((w.window_id, *e) for w in asked.collect() for e in window(edges, w.ts, w.te)), key=repr)
    for strategy in query.STRATEGIES:
        assert rows(query.window_forest(df, asked, strategy, built).select(*query.RESULT)) == expected, strategy


def test_golden_weights_and_lifetime(spark):
    df = table(spark, M1)
    asked = spark.createDataFrame([(i, *w) for i, w in enumerate(M1_WEIGHTS)], "window_id bigint, ts int, te int")
    found = forest.weight_by_key(query.window_forest(df, asked, "quadrant"), "window_id")
    assert {r.window_id: r.total_weight for r in found.collect()} == dict(enumerate(M1_WEIGHTS.values()))
    steps = staircase.staircase(df)
    assert abs(staircase.mean_lifetime(steps, 4).first()[0] - 13 / 7) < 1e-12


@pytest.mark.parametrize("strategy", ["online", "segment", "quadrant", "staircase"])
def test_windows_beyond_the_graph_are_clipped(spark, strategy):
    df = table(spark, M1)
    asked = spark.createDataFrame([(0, -3, 0), (1, 2, 99), (2, 7, 9), (3, -9, -2), (4, 3, 1)], "window_id bigint, ts int, te int")
    found = query.window_forest(df, asked, strategy).select(*query.RESULT)
    assert rows(found) == sorted([(0, *e) for e in window(M1, 0, 0)] + [(1, *e) for e in window(M1, 2, 3)], key=repr)


@pytest.mark.parametrize("edges", [M3, M4, [], [(3, 3, 1, 0)], [(0, 1000, 2, 0), (0, 1000, 2, 0)]])
def test_degenerate_graphs(spark, edges):
    df = model.edges(table(spark, edges))
    total = model.t_count(df)
    asked = windows.all_windows(spark, max(1, total))
    expected = sorted(((w.window_id, *e) for w in asked.collect() for e in window(edges, w.ts, w.te)), key=repr)
    for strategy in ("online", "merged", "segment", "segment_start", "quadrant"):
        assert rows(query.window_forest(df, asked, strategy).select(*query.RESULT)) == expected, strategy


def test_borůvka_and_whole_forest(spark):
    _, _, edges = random_graph(8)
    df = table(spark, edges)
    keyed = df.withColumn("k", df.ts % 2)
    assert rows(forest.boruvka_forest(keyed, "k")) == sorted(((k, *e) for k in (0, 1) for e in kruskal([e for e in edges if e[3] % 2 == k])), key=repr)
    assert rows(forest.forest(df)) == sorted(kruskal(edges), key=repr)


def test_saved_index_answers_as_the_one_built(spark, tmp_path):
    _, total, edges = random_graph(5)
    df = table(spark, edges)
    steps = staircase.staircase(df, 2, t_total=total)
    index.save(steps, total, str(tmp_path / "index"))
    loaded, asked = index.load(spark, str(tmp_path / "index")), windows.all_windows(spark, total)
    assert rows(index.load_staircase(spark, str(tmp_path / "index")).select(*steps.columns)) == rows(steps)
    expected = rows(query.online(df, asked, total).select(*query.RESULT))
    for strategy in ("segment", "segment_start", "quadrant", "staircase", "sorted"):
        assert rows(loaded.query(asked, strategy).select(*query.RESULT)) == expected
        again = query.agreement(loaded.query(asked, strategy), query.online(df, asked, total)).collect()
        assert all(r.n_left == r.n_right == r.n_both and r.weight_left == r.weight_right for r in again)
    short = query.agreement(query.online(df, asked, total).where("window_id > 0 or src > 0"), query.online(df, asked, total)).where("n_left < n_both or n_left <> n_right").count()
    assert short == query.differences(query.online(df, asked, total).where("window_id > 0 or src > 0"), query.online(df, asked, total)).select("window_id").distinct().count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        index.load(spark, str(tmp_path / "none"))


def test_saved_indexes_are_pruned_by_the_windows(spark, tmp_path):
    """Folders are chosen by the windows' nodes: the plan has a dynamic partition filter, and a query reads fewer files than there are."""
    edges = [(i % 5, (i * 3 + 1) % 5, (i * 37) % 11, i % 64) for i in range(900)]
    steps = staircase.staircase(table(spark, edges), 2, t_total=64)
    index.save(steps, 64, str(tmp_path / "index"))
    spark.createDataFrame([(0, 40, 41)], "window_id bigint, ts int, te int").write.parquet(str(tmp_path / "windows"))
    loaded, asked = index.load(spark, str(tmp_path / "index")), spark.read.parquet(str(tmp_path / "windows"))
    expected = sorted(((0, *e) for e in window(edges, 40, 41)), key=repr)
    for strategy, name in (("segment", "rect_nodes"), ("segment_start", "rect_start_nodes"), ("quadrant", "rect_cells"), ("staircase", "rects")):
        found = loaded.query(asked, strategy)
        assert rows(found.select(*query.RESULT)) == expected
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruning" in plan, strategy
    sizes = {r.name: r for r in index.sizes(spark, str(tmp_path / "index")).collect()}
    assert set(sizes) == set(index.TABLES) and all(r.n_files > 1 and r.n_bytes > 0 for r in sizes.values())


def test_plans_are_equi_joins(spark):
    built = query.Index(staircase.rectangles(staircase.staircase(table(spark, M1))), 4)
    for strategy in ("segment", "segment_start", "quadrant", "staircase", "sorted"):
        plan = built.query(windows.all_windows(spark, 4), strategy)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "HashJoin" in plan or "SortMergeJoin" in plan


def test_validation_and_statistics(spark):
    bad = table(spark, [(-1, 2, 3, 4)])
    with pytest.raises(Exception, match="an edge needs"):
        model.edges(bad).collect()
    assert tuple(model.graph_stats(table(spark, M1)).first()) == (4, 8, 4)
    assert tuple(model.graph_stats(table(spark, [])).first()) == (0, 0, 0)
    assert tuple(model.split_point(table(spark, M1), 0.1).first()) == (0, 4)
    ids = spark.createDataFrame([(10, 7), (7, 1000), (None, 10)], "a bigint, b bigint")
    assert rows(model.dense_ids(ids, ["a", "b"])) == [(10, 1), (1000, 2), (7, 0)]


def test_window_generator(spark):
    made = windows.generate(spark, 500, 0.2, 28, seed=4).collect()
    assert len(made) == 500 and all(0 <= w.ts and w.te == w.ts + 5 and w.te < 28 for w in made)
    assert len({w.ts for w in made}) == 23
    assert windows.generate(spark, 5, 0.2, 0).count() == 0
