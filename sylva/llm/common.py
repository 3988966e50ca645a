"""What the operators of this subpackage share: stored intermediate tables and batches of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..storage import new_folder, shared_folder, stored

__all__ = ["lean", "new_folder", "shared_folder", "slices", "stored", "table", "text_slices"]

Batches = Iterator[pa.RecordBatch]


def slices(lengths: list[int], rows: int = 512, chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of at most ``rows`` texts and about ``chars`` characters; a longer text is alone."""
    begin = size = 0
    for i, n in enumerate(lengths):
        if i > begin and (i - begin >= rows or size + n > chars):
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        yield begin, len(lengths)


def text_slices(texts: pa.Array, rows: int = 512, chars: int = 4_000_000) -> Iterator[tuple[int, int, list[str]]]:
    """(begin, end, texts) of the runs that slices() cuts a column into, nulls as empty texts; only one run is held as Python strings."""
    for a, b in slices(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), rows, chars):
        yield a, b, [x or "" for x in texts.slice(a, b - a).to_pylist()]


def lean(run: Callable[[Batches], Batches], *drop: Callable[[], None]) -> Callable[[Batches], Batches]:
    """``run``, for mapInArrow, with freed memory returned to the system at the end of a task, after ``drop`` has emptied caches.

    Python workers are kept for later tasks, and allocators keep what a batch took: without this each
    idle worker holds 100 to 150 MB beside the JVM's next stage.
    """

    @wraps(run)
    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            for empty in drop:
                empty()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
            if trim is not None:
                trim(0)

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
