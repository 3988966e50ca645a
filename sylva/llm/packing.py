"""Best-fit packing of documents into sequences (operator 1).

The plan is made from the histogram of piece lengths alone: best fit, longest first, over counts of
equal lengths, so its size depends on the sequence length and not on the corpus. Every piece then
takes the slot that the plan has for its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stored, text_slices
from .library_tokens import library_ids

#: Ranks are given within hash buckets of a length of this many pieces, or the root of their number if that
#: is more: neither a bucket nor the list of a length's buckets then is large, even if all pieces have one length.
BUCKET_ROWS = 250
PLAN = "length int, rank_from bigint, rank_to bigint, first_sequence bigint, per_sequence bigint, first_offset bigint"


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of PLAN: pieces of ``length`` ranked [rank_from, rank_to) go to the sequences from
    ``first_sequence`` on, ``per_sequence`` in each, the first of each at ``first_offset``.

    Best fit: a run of equal pieces goes to the open sequences with the least room that fits, each
    filled as far as it goes before the next. Sequences with equal contents stay one range, and a
    length splits at most one range in two, so there are O(size) ranges and rows.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    open_: list[tuple[int, int, int]] = []  # room, first sequence, number of sequences
    made = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(open_, (length, -1, -1))
            if at < len(open_):
                room, first, n = open_.pop(at)
            else:
                each = size // length
                room, first, n = size, made, -(-left // each)
                made += n
            each = room // length
            for count, used in ((each, min(n, left // each)), (left % each, 1)):
                # full sequences, then one that takes what is left of the run
                if not count or not used or not n or not left:
                    continue
                rows.append((length, rank, rank + count * used, first, count, size - room))
                if room > count * length:
                    insort(open_, (room - count * length, first, used))
                rank, left, first, n = rank + count * used, left - count * used, first + used, n - used
                if left >= each:
                    break
            if n:
                insort(open_, (room, first, n))
    return rows


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids with ``end_id`` at the end.

    A null or empty text is the end id alone. Only documents of more than ``size`` ids are cut: the
    first piece takes the remainder, the others are full. Repeated rows give pieces each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_ids(tokenizer)
        for batch in batches:
            for a, _, texts in text_slices(batch.column(1)):
                rows: list[tuple] = []
                for row, ids in enumerate(encoder.encode(texts), a):
                    ids = np.append(ids, end_id).astype("<u4")
                    cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
                    rows += [(row, k, i, j - i, zlib.crc32(ids[i:j])) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
                row, k, i, n, crc = map(list, zip(*rows, strict=True))
                arrays = [batch.column(0).take(pa.array(row)), pa.array(k, pa.int32()), pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(lean(run, library_ids.cache_clear), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def assign(parts: DataFrame, size: int) -> DataFrame:
    """``parts`` (with doc_id, piece, length and ids_crc32) plus sequence_id and offset.

    Lengths must lie in 1..size. ``parts`` is read three times and should be a stored table. The plan
    that is broadcast has O(size) rows whatever the corpus; rows equal in all columns are
    interchangeable, so ties change nothing but which of them comes first.
    """
    spark = parts.sparkSession
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    slots = spark.createDataFrame(plan(histogram, size), PLAN)
    dealing = spark.createDataFrame([(n, max(1, k // max(BUCKET_ROWS, isqrt(k)))) for n, k in histogram.items()], "length bigint, _buckets bigint")
    dealt = parts.join(F.broadcast(dealing), "length").withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "_buckets"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    bases = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1).join(bases, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    slots = slots.withColumnRenamed("length", "_length")
    on = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to"))
    place = F.col("_rank") - F.col("rank_from")
    return ranked.join(F.broadcast(slots), on).select(
        *parts.columns,
        (F.col("first_sequence") + F.floor(place / F.col("per_sequence"))).cast("bigint").alias("sequence_id"),
        (F.col("first_offset") + place % F.col("per_sequence") * F.col("length")).cast("bigint").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    An empty table gives an empty table; columns of ``docs`` other than the two named are not read.
    """
    return assign(stored(pieces(docs, tokenizer, size, end_id, id_col, text_col), "pieces"), size)
