"""Quality rules in a short-circuit cascade of DataFrame expressions (operator 5).

Rules look at measures of the text, and measures share parts such as its words. What every measure
costs and which rules reject a document are found on a sample; rules are then ordered by documents
newly rejected per second of measures not yet known. One nested expression evaluates them in that
order: a measure is bound when the first rule that needs it is reached, once, and not at all for a
document rejected before. The order changes cost alone: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: White space of the contract: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Rules are measured on about this many rows, chosen by a hash from all of them; nothing but the order depends on it.
SAMPLE_ROWS = 1000
SYMBOLS = r"[#*$%&|<>]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The words of a text, an empty array without any."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def removed(text: Column, pattern: str) -> Column:
    """How many code points the pattern's matches have."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("bigint")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def n_repeat_words(found: Column) -> Column:
    """Of an array of words, those in windows of three that it has twice or more.

    Windows are hashed to 64 bits. Only if some hash repeats are (hash, position) pairs sorted, so
    that equal windows become neighbours; the positions found are then merged into covered words.
    """

    def covered(found: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
        step = lambda s, p: F.struct((s["n"] + 3 - F.greatest(F.lit(0), s["end"] - p)).alias("n"), (p + 3).alias("end"))
        return F.aggregate(F.sort_array(found), start, step, lambda s: s["n"])

    def repeated(pairs: Column) -> Column:
        near = lambda x, i: (F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"])
        return F.transform(F.filter(pairs, lambda x, i: F.coalesce(near(x, i), F.lit(False))), lambda x: x["at"])

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(covered(let(pairs, repeated)))

    hashes = F.transform(F.sequence(F.lit(0), F.size(found) - 3), lambda i: F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)))
    return F.when(F.size(found) < 3, F.lit(0).cast("bigint")).otherwise(let(hashes, count))


@dataclass(frozen=True)
class Measure:
    """``of`` the text and of the measures it needs, which come before it in MEASURES; a ``free`` one costs nothing beyond those."""

    of: Callable[[Column, dict[str, Column]], Column]
    needs: tuple[str, ...] = ()
    free: bool = False


#: Every measure a rule can use, and the parts that several share.
MEASURES: dict[str, Measure] = {
    "words": Measure(lambda t, m: words(t)),
    "lines": Measure(lambda t, m: worded_lines(t)),
    "n_words": Measure(lambda t, m: F.size(m["words"]).cast("bigint"), ("words",), free=True),
    "word_chars": Measure(lambda t, m: F.length(F.array_join(m["words"], "")).cast("bigint"), ("words",)),
    "n_symbols": Measure(lambda t, m: removed(t, SYMBOLS)),
    "n_lines": Measure(lambda t, m: F.size(m["lines"]).cast("bigint"), ("lines",), free=True),
    "n_dup_lines": Measure(lambda t, m: (F.size(m["lines"]) - F.size(F.array_distinct(m["lines"]))).cast("bigint"), ("lines",)),
    "n_repeat_words": Measure(lambda t, m: n_repeat_words(m["words"]), ("words",)),
    "n_capitals": Measure(lambda t, m: removed(t, r"\p{Lu}+")),
    "n_letters": Measure(lambda t, m: removed(t, r"\p{L}+")),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a document if ``reject``, given the measures ``needs`` by name, holds."""

    name: str
    needs: tuple[str, ...]
    reject: Callable[[dict[str, Column]], Column]


BASE_RULES = (
    Rule("too_short", ("n_words",), lambda m: m["n_words"] < 50),
    Rule("repetition", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_symbols", "n_words"), lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("shouting", ("n_capitals", "n_letters"), lambda m: 100 * m["n_capitals"] > 40 * m["n_letters"]),
    Rule("few_letters", ("n_letters", "word_chars"), lambda m: 100 * m["n_letters"] < 50 * m["word_chars"]),
    Rule("word_length", ("word_chars", "n_words"), lambda m: (m["word_chars"] < 3 * m["n_words"]) | (m["word_chars"] > 10 * m["n_words"])),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
)


def _missing(names: Iterable[str], known: Iterable[str]) -> list[str]:
    """The measures to bind, parts first, before all of ``names`` are known."""
    wanted: set[str] = set()
    todo = [x for x in names if x not in known]
    while todo:
        name = todo.pop()
        wanted.add(name)
        todo += [x for x in MEASURES[name].needs if x not in known and x not in wanted]
    return [x for x in MEASURES if x in wanted]


def bound(text: Column, names: Iterable[str], then: Callable[[dict[str, Column]], Column], known: dict[str, Column] | None = None) -> Column:
    """``then`` of the known measures and of ``names``, each evaluated once and only if this expression is."""
    known = dict(known or {})
    missing = _missing(names, known)
    if not missing:
        return then(known)
    return let(MEASURES[missing[0]].of(text, known), lambda x: bound(text, missing[1:], then, known | {missing[0]: x}))


def _sample(docs: DataFrame, text_col: str, rows: int) -> DataFrame:
    """About ``rows`` texts of any length from all of ``docs``, by a hash of text and a number, as a stored table."""
    n = docs.count()
    one = 1 << 30
    share = int(one * min(1.0, rows / max(1, n)))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    texts = docs.select(text.alias("text"), F.monotonically_increasing_id().alias("at"))
    return stored(texts.where(F.pmod(F.xxhash64(F.lit(5), "text", "at"), F.lit(one)) < share).select("text").coalesce(8), "rules-sample")


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules, next always the one that newly rejects most of the sample per second of measures not known by then.

    Rows of answers come to the driver, one boolean a rule for each of about ``sample_rows`` documents.
    """
    sample, text = _sample(docs, text_col, sample_rows), F.col("text")
    names = _missing([x for r in rules for x in r.needs], ())
    answers = bound(text, names, lambda m: F.array(*(F.coalesce(r.reject(m), F.lit(False)) for r in rules)))
    found = [r["a"] for r in sample.select(answers.alias("a")).collect()]
    if not any(map(any, found)):
        return list(rules)

    def seconds(name: str | None) -> float:
        use = lambda m: F.size(m[name]) if name in ("words", "lines") else m[name]
        value = bound(text, [name], use) if name else F.length(text)
        began = time.perf_counter()
        sample.agg(F.count_if(value < 0)).first()
        return time.perf_counter() - began

    seconds(None)
    floor = seconds(None)
    whole = {x: max(1e-4, seconds(x) - floor) for x in names if not MEASURES[x].free}
    own = {x: 1e-4 if MEASURES[x].free else max(1e-4, whole[x] - sum(whole[y] for y in MEASURES[x].needs)) for x in names}
    order: list[Rule] = []
    known: list[str] = []
    left = list(range(len(rules)))
    while left:
        gain = {i: sum(a[i] for a in found) for i in left}
        cost = {i: 1e-4 + sum(own[x] for x in _missing(rules[i].needs, known)) for i in left}
        best = max(left, key=lambda i: (gain[i] / cost[i], -cost[i], rules[i].name))
        left.remove(best)
        order.append(rules[best])
        known += _missing(rules[best].needs, known)
        found = [a for a in found if not a[best]]
    return order


def first_rejection(rules: list[Rule], text: Column, known: dict[str, Column] | None = None) -> Column:
    """The name of the first rule that rejects, null if none does; later rules and their measures are not evaluated."""
    if not rules:
        return F.lit(None).cast("string")
    rule, rest = rules[0], rules[1:]
    return bound(text, rule.needs, lambda m: F.when(rule.reject(m), F.lit(rule.name)).otherwise(first_rejection(rest, text, m)), known)


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that no rule rejects.

    A null text counts as empty and goes. Rows are judged one by one: repeated rows stay or go
    together, ids and other columns are not looked at, and an empty table gives an empty one.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.where(first_rejection(ordered(docs, rules, text_col), text).isNull())


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every row: doc_id, the base measures, base_failed and kept.

    Null and empty texts have no words and fail; a null id stays; repeated rows give a row each; an
    empty table gives an empty one. The base measures are computed for all rows as they are returned;
    the verdict takes them, and their words and lines, from there and evaluates the other measures only
    where the cascade gets to them.
    """
    order = ordered(docs, rules, text_col)
    text = F.coalesce(F.col("text"), F.lit(""))

    def verdict(m: dict[str, Column]) -> Column:
        failed = BASE_RULES[0].reject(m) | BASE_RULES[1].reject(m)
        kept = F.when(failed, F.lit(False)).otherwise(first_rejection(order, text, m).isNull())
        return F.struct(*(m[k].alias(k) for k in BASE), failed.alias("base_failed"), kept.alias("kept"))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", bound(text, BASE, verdict).alias("found"))
    return rows.select("doc_id", *(F.col("found")[k].alias(k) for k in (*BASE, "base_failed", "kept")))
