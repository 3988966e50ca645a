import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="session")
def oracle():
    """A DuckDB connection over the smallest tables, and a comparison of a query with its SQL."""
    import duckdb

    folder = DATA / "sf0.001"
    connection = duckdb.connect()
    for p in folder.glob("*.parquet"):
        connection.execute(f"create view {p.stem} as select * from read_parquet('{p}')")

    def compare(spark, query, sql):
        found = query(spark, str(folder))
        names = sorted(found.columns)
        expected = connection.execute(sql)
        columns = [d[0] for d in expected.description]
        assert sorted(columns) == names
        ours = sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr)
        theirs = sorted((tuple(r[columns.index(n)] for n in names) for r in expected.fetchall()), key=repr)
        assert ours == theirs

    return compare
