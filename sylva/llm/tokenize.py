"""Token ids and texts of whole columns by the byte-level BPE of bpe.py (operator 7)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_bpe
from .common import slices


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<bigint>) of every text, as the tokenizers library does without its special tokens.

    A null text counts as empty and has no ids; a null id stays null; repeated rows give a row each;
    other columns are not read. ``tokenizer`` is the path of a byte-level BPE file on every worker.
    Strings of the file's special tokens in a text give their ids, as in the library.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(x) for x in texts]):
                ids, counts = model.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), column], ["id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "id bigint, ids array<bigint>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every array of ids, special tokens included. A null array, or a null in it, counts as nothing; an id outside the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(tokenizer)
        for batch in batches:
            lists = [np.array([i for i in x or () if i is not None], np.int64) for x in batch.column(1).to_pylist()]
            for a, b in slices([len(x) for x in lists], chars=1_000_000):
                texts = model.decode(np.concatenate(lists[a:b]), np.array([len(x) for x in lists[a:b]]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(texts, pa.string())], ["id", "text"])

    ids = tokens.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).cast("array<bigint>").alias("ids"))
    return ids.mapInArrow(run, "id bigint, text string").withColumnRenamed("id", id_col)


def round_trip_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass, so that no ids are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(tokenizer)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(x) for x in texts]):
                ids, counts = model.encode(texts[a:b])
                ends = np.concatenate([[0], np.cumsum(counts)])
                raw = ids.astype("<u4")
                of_ids = [sha(raw[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                of_text = [sha(x.encode()) for x in model.decode(ids, counts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _texts(docs, id_col, text_col).mapInArrow(run, "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
