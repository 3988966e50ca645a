"""Intermediate tables in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
#: The folders made within each open scope, the innermost last.
_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    Only a local session without that setting (as in tests) gets a temporary folder; on a
    cluster a missing setting is an error, since executors do not share local folders.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="sylva-")
        _FOLDERS[app] = f"{base.rstrip('/')}/sylva-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        _delete(spark, folder)
    except Exception:  # the JVM has already gone
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPES:
        _SCOPES[-1].append(folder)
    return folder


def stored(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_in = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again; other DataFrames are left alone."""
    for table in tables:
        if path := getattr(table, "stored_in", None):
            _delete(table.sparkSession, path)


@contextmanager
def scope(spark: SparkSession, *kept: DataFrame) -> Iterator[list[DataFrame]]:
    """Deletes the tables stored within it at its end, but for those that the block appends to the list given.

    What the block returns lazily must itself be stored and appended, as it may read the others.
    """
    keep = list(kept)
    _SCOPES.append([])
    try:
        yield keep
    finally:
        made = _SCOPES.pop()
        stay = {getattr(x, "stored_in", None) for x in keep}
        for folder in made:
            if folder in stay:
                if _SCOPES:
                    _SCOPES[-1].append(folder)
            else:
                _delete(spark, folder)
