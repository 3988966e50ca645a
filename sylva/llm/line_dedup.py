"""Line dedup across documents (operator 2).

Keys of lines are exploded as 128-bit hashes, once for each document; a key in many documents keeps
its lines in the document with the largest id and loses them elsewhere. The positions to drop are
gathered for each document, and its text is put together again without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .quality_rules import SPACES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case. Lower-casing an all-ASCII line is the same and faster."""
    key = F.btrim(line, F.lit(SPACES))
    return F.when(F.length(key) == F.octet_length(key), F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


def _hashes(text: Column, min_chars: int) -> Column:
    """For each line its key's hash as two longs, null for a shorter key."""

    def of(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.length(F.btrim(line, F.lit(SPACES))) >= min_chars, F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")))

    return F.transform(F.split(text, "\n"), of)


def dedup_rows(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``row`` (all its columns, in a struct), lines array<string>,
    kept array<string> (the lines that stay, in order).

    A null text counts as one empty line. Documents are counted by id: rows with one id, equal or
    not, are one document, and all of them keep the lines of the keys whose largest id they have.
    Rows without an id are one document too, below all others. An empty table gives an empty one;
    columns are held in a struct, so any names will do.

    Rows bound documents from above, so keys are first counted by row, which combines on the map side,
    and only lines of keys in ``min_docs`` rows go on to the exact count. A very common key meets its
    few counts in joins that adaptive execution can split. Nothing is collected but a document's own
    line positions.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    source = docs.select(F.struct("*").alias("row"), docs[id_col].alias("id"), text.alias("text"))
    hashed = stored(source.select("id", F.xxhash64("text").alias("of"), _hashes(F.col("text"), min_chars).alias("keys")), "line-keys")
    once = hashed.select("id", F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")
    rows = once.groupBy("key.h", "key.g").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h", "g")
    rows = stored(rows, "common-rows")  # stored, so that the joins below can split a very common key
    each = hashed.select("id", "of", F.posexplode("keys").alias("at", "key")).where("key is not null").select("id", "of", "at", "key.h", "key.g")
    each = stored(each.join(rows, ["h", "g"]), "common-places")
    holders = each.select("h", "g", "id").distinct()
    common = holders.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("id").alias("owner")).where(F.col("n") >= min_docs)
    common = stored(common.select("h", "g", "owner"), "common-lines")
    lost = each.join(common, ["h", "g"]).where(~F.col("id").eqNullSafe(F.col("owner")))
    drops = lost.groupBy(F.col("id").alias("drop_id"), F.col("of").alias("drop_of")).agg(F.collect_list("at").alias("drop"))
    same = F.col("id").eqNullSafe(F.col("drop_id")) & (F.xxhash64("text") == F.col("drop_of"))
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce(F.col("drop"), F.array().cast("array<int>")))
    joined = source.join(drops, same, "left").select("row", lines.alias("lines"), "drop")
    return joined.select("row", "lines", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i))).alias("kept"))


def dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines gone from its texts; a document stays even if no line does. See dedup_rows."""
    rows = dedup_rows(docs, min_chars, min_docs, id_col, text_col)
    text = F.when(F.col("row")[text_col].isNull(), None).otherwise(F.array_join("kept", "\n"))
    return rows.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def digest(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    rows = dedup_rows(docs, min_chars, min_docs)
    n = F.size("lines").cast("bigint")
    return rows.select(F.col("row.doc_id").alias("doc_id"), n.alias("n_lines"), (n - F.size("kept")).alias("n_dropped"), F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))
