"""Language identification by rank-order profiles of n-grams (operator 9).

A language's profile is its most frequent letter n-grams (one to three letters, with the blank at
word ends) in order of frequency. A document is ranked the same way, and goes to the language with
the least out-of-place distance: the sum over its n-grams of how far their ranks are apart, or the
profile's length for an n-gram that the profile lacks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lean, text_slices

UNDETERMINED = "und"
PROFILE = 300
#: fit() learns a language's profile from about this many documents at most; keep() learns from all.
FIT_DOCS = 5000
#: keep() rejects texts whose best language is less similar than LEAST times what LOW of the learned documents stay below.
LOW, LEAST = 0.01, 0.6
#: N-grams take about 70 bytes a character while they are made, so texts are taken in slices of this many (a longer one alone).
SLICE_CHARS = 100_000
#: A task adds up its counts of n-grams whenever it holds this many of them (16 bytes each).
HELD_GRAMS = 300_000
#: Similarities are counted in this many steps from 0 to 1.
STEPS = 10_000
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SHIFT = 21  # bits of a code point
_BLANK = 32


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts as numbers, grouped by text, and how many each text has."""
    plain = [f" {_NOT_LETTERS.sub(' ', x.lower()).strip()} " for x in texts]
    chars = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32).astype(np.int64)
    blank = chars == _BLANK
    keys, some = np.empty((len(chars), 3), np.int64), np.zeros((len(chars), 3), bool)  # those that begin at each character
    keys[:, 0] = chars
    keys[:-1, 1] = chars[:-1] << _SHIFT | chars[1:]
    keys[:-2, 2] = keys[:-2, 1] << _SHIFT | chars[2:]
    some[:, 0] = ~blank
    some[:-1, 1] = ~(blank[:-1] & blank[1:])
    some[:-2, 2] = ~blank[1:-1]
    begins = np.cumsum([0, *map(len, plain[:-1])]) if plain else np.empty(0, np.int64)  # no text is empty between its blanks
    return keys[some], np.add.reduceat(some.sum(1), begins)


def ranked(keys: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent numbers, the most frequent first, ties by number."""
    found, counts = np.unique(keys, return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], size: int, floor: float = 0.0) -> None:
        self.floor = floor
        self.size, self.langs, self.profiles = size, sorted(profiles), profiles
        self.keys = np.unique(np.concatenate([np.array(profiles[x], np.int64) for x in self.langs])) if profiles else np.empty(0, np.int64)
        self.ranks = np.full((len(self.langs), len(self.keys) + 1), -1, np.int64)
        for row, lang in enumerate(self.langs):
            self.ranks[row, np.searchsorted(self.keys, profiles[lang])] = np.arange(len(profiles[lang]))

    def similarity(self, keys: np.ndarray) -> np.ndarray:
        """For each language 1 less its out-of-place distance over the greatest possible one."""
        top = ranked(keys, self.size)
        at = np.minimum(np.searchsorted(self.keys, top), max(0, len(self.keys) - 1))
        known = self.keys[at] == top
        ranks = self.ranks[:, np.where(known, at, len(self.keys))]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))))
        return 1 - apart.sum(1) / (self.size * len(top))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """A language and a score from 0 to 1, its share of all languages' similarity, for each text; "und" below the least similarity."""
        keys, counts = grams(texts)
        ends, out = np.concatenate([[0], np.cumsum(counts)]), []
        for text, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
            if not self.langs or not any(map(str.isalpha, text)) or a == b:
                out.append((UNDETERMINED, 0.0))
                continue
            like = self.similarity(keys[a:b])
            best = int(np.argmax(like))
            if like[best] < self.floor:
                out.append((UNDETERMINED, 0.0))
                continue
            out.append((self.langs[best], float(like[best] / like.sum()) if like.sum() > 0 else 0.0))
        return out


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def learned(docs: DataFrame, fit_docs: int | None = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame | None:
    """(lang, text) of the documents that fit() learns from, or of all that may be learned from where ``fit_docs`` is None; None without any."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("id")) & F.col("lang").isNotNull())
    if fit_docs is None:
        return rows.where(F.col("text").isNotNull()).select("lang", "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    one = 1 << 30
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, int(one * min(1.0, fit_docs / n))).otherwise(share)
    return rows.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(one)) < share)).select("lang", "text")


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, profile: int = PROFILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from the texts of documents with a language that are not held out.

    A language with more than ``fit_docs`` such documents is thinned to about that many by a hash of
    the id (a bound on learning alone). What comes to the driver is one count a language and
    ``profile`` numbers a language. Rows with a null id, text or language teach nothing.
    """
    return _profiles(learned(docs, fit_docs, id_col, text_col, lang_col), profile)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of numbers, (numbers, counts) each, added up."""
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def _profiles(chosen: DataFrame | None, profile: int) -> Profiles:
    if chosen is None:
        return Profiles({}, profile)

    def told(held: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, n = _added(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = {}, 0
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b, texts in text_slices(batch.column(1), chars=SLICE_CHARS):
                for lang in sorted(set(langs[a:b])):
                    found = np.unique(grams([t for t, x in zip(texts, langs[a:b], strict=True) if x == lang])[0], return_counts=True)
                    held.setdefault(lang, []).append(found)
                    waiting += len(found[0])
                if waiting > HELD_GRAMS:
                    held = {lang: [_added(parts)] for lang, parts in held.items()}
                    waiting = sum(len(parts[0][0]) for parts in held.values())
                    if waiting > HELD_GRAMS // 2:
                        yield from told(held)
                        held, waiting = {}, 0
        yield from told(held)

    totals = chosen.mapInArrow(lean(run), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = totals.withColumn("place", place).where(F.col("place") <= profile).orderBy("lang", "place").collect()
    found: dict[str, list[int]] = {}
    for r in top:
        found.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(found, profile)


def predict(docs: DataFrame, model: Profiles, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all by default) in a struct ``row``, with lang_pred and score; a null text, or one without a letter, is "und" with score 0.

    The text goes to Python once and, if it is carried, comes back as it is.
    """
    names = docs.columns if carry is None else carry
    back = text_col in names
    shared = docs.sparkSession.sparkContext.broadcast((model.profiles, model.size, model.floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Profiles(*shared.value)
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1), chars=SLICE_CHARS):
                langs, scores = zip(*own.predict(texts), strict=True)
                columns = {"rest": batch.column(0).slice(a, b - a), **({"text": batch.column(1).slice(a, b - a)} if back else {}), "lang_pred": pa.array(langs), "score": pa.array(scores, pa.float64())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rest = F.struct(F.lit(True).alias("_"), *(docs[c] for c in names if c != text_col)).alias("rest")
    rows = docs.select(rest, docs[text_col].cast("string").alias("text"))
    schema = StructType([rows.schema["rest"], *([rows.schema["text"]] if back else [])]).add("lang_pred", "string").add("score", "double")
    out = rows.mapInArrow(lean(run), schema)
    row = F.struct(*(F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in names)).alias("row")
    return out.select(row, "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, by profiles learned from those not held out.

    Texts that are null or have no letter are "und" with score 0, as is every text where no document
    has a language. Languages with equal distances: the first by name. Repeated rows give a row each; a
    null id stays, counts as not held out, but teaches nothing; an empty table gives an empty one.
    """
    model = fit(docs)
    found = predict(docs, model, carry=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), F.coalesce(held_out(F.col("row.doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def least_similarity(chosen: DataFrame, model: Profiles) -> float:
    """The similarity below which a text is in none of the languages: LEAST times what a share LOW of the texts given stay below, each with its best language.

    Every text counts, by its similarity rounded down to one of STEPS; one count a step comes to the driver.
    """
    shared = chosen.sparkSession.sparkContext.broadcast((model.profiles, model.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = Profiles(*shared.value), np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0), chars=SLICE_CHARS):
                keys, sizes = grams(texts)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                like = [float(own.similarity(keys[i:j]).max()) for i, j in zip(ends[:-1], ends[1:], strict=True) if i < j]
                counts += np.bincount((np.array(like) * STEPS).astype(np.int64), minlength=STEPS + 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["step", "n"])

    found = chosen.select("text").mapInArrow(lean(run), "step int, n bigint").groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").collect()
    below = np.cumsum([r["n"] for r in found])
    low = found[int(np.searchsorted(below, LOW * below[-1]))]["step"] / STEPS if found else 0.0
    return max(LEAST * low, 1e-9)


def keep(docs: DataFrame, min_similarity_share: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose language can be told (not "und") with at least the score given.

    A text that is too far from the profiles of all languages is "und" here; see least_similarity.
    Profiles and this limit are learned from all documents with a language that are not held out.
    Null texts and texts without letters go; of languages with equal distances the first by name is
    taken; repeated rows stay or go together; null ids are no matter; columns are held in a struct, so
    any names will do; an empty table gives an empty one.
    """
    chosen = learned(docs, None)
    model = _profiles(chosen, PROFILE)
    if model.langs:
        model.floor = least_similarity(chosen, model)
    found = predict(docs, model)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_similarity_share)).select("row.*")
