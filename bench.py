"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from sylva import graphs, model  # noqa: E402
from sylva.operators import forest, staircase  # noqa: E402
from sylva.plans import query, windows  # noqa: E402
from sylva.storage import stored  # noqa: E402
from sylva.streaming import sliding  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: The workload of the published example: 1,000 windows, each a fifth of the timeline.
WINDOWS, RATIO = 1000, 0.2


def timed(times: dict[str, float], name: str, make) -> DataFrame:
    began = time.perf_counter()
    out = make()
    if isinstance(out, DataFrame):
        out.write.format("noop").mode("overwrite").save()
    times[name] = round(time.perf_counter() - began, 3)
    return out


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    spark.range(1000).repartition(2).mapInArrow(lambda b: b, "id long").count()  # starts workers
    monthly = stored(graphs.trade(spark, SF, "month"), "trade")
    total = model.t_count(monthly)
    supply = stored(graphs.supply(spark, SF), "supply")

    timed(times, "local_forest_trade", lambda: forest.local_forest(monthly))
    timed(times, "local_forest_supply", lambda: forest.local_forest(supply))
    timed(times, "forest_supply", lambda: forest.forest(supply))
    local = stored(forest.local_forest(monthly), "local")
    steps = {}
    timed(times, "build_staircase_blocks_1", lambda: staircase.staircase(local, 1, True, total))
    timed(times, "build_staircase_blocks_8", lambda: steps.setdefault("s", stored(staircase.staircase(local, 8, True, total), "steps")))
    timed(times, "build_incremental", lambda: sliding.incremental_staircase(local, int(total * 0.8), total))
    index = query.Index(stored(staircase.rectangles(steps["s"]), "rects"), total)
    asked = windows.generate(spark, WINDOWS, RATIO, total, seed=1)
    timed(times, "query_online", lambda: query.online(local, asked, total, reduced=True))
    timed(times, "query_merged", lambda: query.merged(local, asked, total, reduced=True))
    for strategy in ("staircase", "sorted", "segment", "segment_start", "quadrant"):
        timed(times, f"query_{strategy}", lambda s=strategy: index.query(asked, s))
    big = windows.generate(spark, 20, RATIO, model.t_count(supply), seed=1)
    timed(times, "query_online_supply_20", lambda: query.online(supply, big, model.t_count(supply)))

    try:
        from sylva.llm import queries as llm
    except ImportError:
        llm = None
    for name, run in (llm.QUERIES if llm else {}).items():
        timed(times, name, lambda f=run: f(spark, SF))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF.rpartition("sf")[2]}), flush=True)


if __name__ == "__main__":
    main()
