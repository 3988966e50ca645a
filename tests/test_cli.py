from conftest import rows
from graphs_by_hand import M1, window

from sylva import cli
from sylva.plans import windows


def test_build_query_and_replay(spark, tmp_path, capsys):
    graph, index, asked, out = (str(tmp_path / n) for n in ("graph", "index", "windows", "out"))
    spark.createDataFrame(M1, "src int, dest int, weight int, ts int").write.parquet(graph)
    cli.main(["stats", graph])
    cli.main(["windows", graph, asked, "--count", "20", "--ratio", "0.4"])
    made = spark.read.parquet(asked).collect()
    assert len(made) == 20 and all(w.te - w.ts == windows.window_size(4, 0.4) for w in made)
    cli.main(["build", graph, index, "--base-ratio", "0.5"])
    expected = sorted(((w.window_id, *e) for w in made for e in window(M1, w.ts, w.te)), key=repr)
    for strategy in ("segment", "online"):
        cli.main(["query", graph, asked, out, "--index", index, "--strategy", strategy])
        assert rows(spark.read.parquet(out).select("window_id", "src", "dest", "weight", "ts")) == expected
    cli.main(["sample", graph, "--count", "3"])
    (tmp_path / "e.txt").write_text("1 2 5\n2 3 6\n1 3 7\n")
    cli.main(["prepare", str(tmp_path / "e.txt"), str(tmp_path / "stream")])
    cli.main(["stream", str(tmp_path / "stream"), "--width", "50"])
    assert "insert" in capsys.readouterr().out
