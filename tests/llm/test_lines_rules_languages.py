import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from edge_cases import LONG, TEXTS, awkward, documents, empty

from sylva.llm import language_id, line_dedup, quality_rules, queries

SPACE = " \t\n\x0b\f\r"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, oracle, name):
    oracle(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def plain_lines(docs, min_chars=40, min_docs=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    holders = {}
    for d, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders.setdefault(k, set()).add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != d)]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_line_dedup_against_brute_force(spark):
    r = random.Random(3)
    lines = ["A line that is Shared by many, and long enough", "  a line that is shared BY many, and long enough\t", "É line that is shared by many, and long enough", "é line that is shared by many, and long enough", "short shared", "x" * 40, "x" * 39]
    docs = [(i, "\n".join(r.choice([*lines, f"a line of document {i} alone that is long enough", ""]) for _ in range(r.randint(1, 12)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r.doc_id: tuple(r)[1:] for r in line_dedup.digest(df).collect()} == plain_lines(docs)


def test_line_dedup_of_awkward_tables(spark):
    found = line_dedup.digest(documents(spark))
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == plain_lines(list(enumerate(TEXTS)))
    assert line_dedup.digest(empty(spark)).count() == 0
    df = awkward(spark)
    kept = line_dedup.dedup(df, min_docs=1000)
    assert kept.columns == df.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, df.collect()))


def test_documents_are_counted_by_id(spark):
    import duckdb

    a, b = "a line that all these documents have in common", "another line, as long, that some of them have too"
    for ids, lost in (([1, 1, 2, 2, 3, 3], []), ([1, 2, 2, 3, 3, None], []), ([1, 2, 2, 3, 4, 4, None], [None, 1, 2, 2, 3]), ([7, 7, 7, 7, 8], [])):
        rows = [(i, a if k % 2 else f"{a}\n{b} {k % 3}") for k, i in enumerate(ids)]
        same = spark.createDataFrame(rows, "doc_id bigint, text string")
        found = line_dedup.digest(same).collect()
        assert sorted((r.doc_id for r in found if r.n_dropped), key=lambda x: x or 0) == lost
        with duckdb.connect() as c:
            c.execute("create table documents (doc_id bigint, text varchar)")
            c.executemany("insert into documents values (?, ?)", rows)
            assert sorted(map(tuple, found), key=repr) == sorted(c.execute(queries.ORACLE_SQL["op2_line_dedup"]).fetchall(), key=repr)


def plain_measures(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_measures_against_brute_force(spark):
    r = random.Random(4)
    made = [" ".join(r.choice(["a", "b", "c|", "d#", "e\n", "\x0bé", "f\x1c"]) for _ in range(r.randint(0, 150))) for _ in range(80)]
    texts = [*TEXTS, *made]
    for row in quality_rules.judge(documents(spark, texts)).collect():
        assert tuple(row)[1:7] == plain_measures(texts[row.doc_id]), texts[row.doc_id]
        assert not (row.base_failed and row.kept)


def test_rules_keep_prose_and_reject_junk(spark):
    letters = [a + b for a in "bcdfgh" for b in "aeiou"]
    prose = " ".join(f"The {a}lor {a}min, and {a}tes {a}ra." for a in letters)
    junk = {"symbols": " ".join(f"some{i}### thing{i}***" for i in range(60)), "shouting": " ".join(f"LOUD{i} CRY{i}!!" for i in range(60)), "repetition": "buy this now please " * 40, "too_short": "few words", "few_letters": " ".join(str(10**6 + i) for i in range(90)), "word_length": " ".join(f"extraordinarylongword{i}" for i in range(60)), "repeated_lines": "\n".join([prose, *["same line"] * 9])}
    names = list(junk)
    df = documents(spark, [prose, *junk.values()])
    assert [r.doc_id for r in quality_rules.keep(df).collect()] == [0]
    text = quality_rules.F.coalesce(df.text, quality_rules.F.lit(""))
    for rule in quality_rules.RULES:
        hit = df.where(quality_rules.bound(text, rule.needs, rule.reject)).collect()
        assert names.index(rule.name) + 1 in {r.doc_id for r in hit} and 0 not in {r.doc_id for r in hit}


def test_the_order_of_rules_follows_rejections_per_cost_and_changes_no_result(spark):
    df = documents(spark, ["buy this now please " * 40] * 30 + ["LOUD CRY! " * 3] * 60)
    order = quality_rules.ordered(df)
    assert sorted(r.name for r in order) == sorted(r.name for r in quality_rules.RULES)
    assert order[0].name in ("too_short", "shouting")
    first = quality_rules.first_rejection(list(reversed(order)), df.text)
    assert df.where(first.isNull()).count() == quality_rules.keep(df).count() == 0


def test_a_rule_that_shares_known_measures_comes_before_one_that_does_not(spark):
    docs = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    order = [r.name for r in quality_rules.ordered(docs)]
    assert order.index("word_length") - order.index("too_short") != 0
    texts = [r.text for r in docs.select("text").collect()]
    every = quality_rules.judge(docs).where("kept").count()
    assert every == quality_rules.keep(docs).count() and len(texts) == docs.count()
    for k in range(3):
        shuffled = random.Random(k).sample(order, len(order))
        rules = sorted(quality_rules.RULES, key=lambda r: shuffled.index(r.name))
        assert docs.where(quality_rules.first_rejection(rules, quality_rules.F.coalesce("text", quality_rules.F.lit(""))).isNull()).count() == every


def test_rules_on_awkward_tables(spark):
    df = awkward(spark)
    assert quality_rules.judge(df).count() == df.count()
    assert quality_rules.keep(df).columns == df.columns
    assert quality_rules.judge(empty(spark)).count() == quality_rules.keep(empty(spark)).count() == 0


def test_the_rules_plan_has_no_python(spark):
    plan = quality_rules.judge(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def plain_ranks(text, size):
    counts = Counter()
    for word in re.sub(r"[\W\d_]+", " ", text.lower()).split():
        padded = f" {word} "
        counts.update(g for n in (1, 2, 3) for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g.strip())
    return counts


def test_ngrams_against_brute_force():
    texts = ["Der Hund, und die Katze 12!", "", "éa b_b Éa", "x"]
    keys, counts = language_id.grams(texts)
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    at = 0
    for text, n in zip(texts, counts, strict=True):
        # a blank of the padding between two words is shared, one-letter n-grams and word ends are not
        assert Counter(keys[at : at + n].tolist()) == Counter({code(g): c for g, c in plain_ranks(text, 300).items()})
        at += n


def test_a_slice_of_texts_takes_little_memory():
    import tracemalloc

    import pyarrow as pa

    from sylva.llm.common import text_slices

    texts = pa.array(["some plain words, and a few more " * 60] * 1000)
    tracemalloc.start()
    n = sum(language_id.grams(x)[1].sum() for _, _, x in text_slices(texts, chars=language_id.SLICE_CHARS))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1000 * plain_ranks(texts[0].as_py(), 300).total() and most < 20_000_000


def test_out_of_place_distance():
    p = language_id.Profiles({"a": [5, 6, 7], "b": [7, 9]}, 3)
    like = dict(zip(p.langs, p.similarity(np.array([7, 7, 7, 6, 6, 4])).tolist(), strict=True))
    assert like == {"a": 1 - (2 + 0 + 3) / 9, "b": 1 - (0 + 3 + 3) / 9}


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)


def test_language_of_awkward_tables(spark):
    docs = spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).select("doc_id", "text", "lang")
    extra = awkward(spark).selectExpr("doc_id + 1000000 as doc_id", "text", "lang")
    found = {r.doc_id: r.lang_pred for r in language_id.identify(docs.unionByName(extra)).where("doc_id >= 1000000 or doc_id is null").collect()}
    for i, t in enumerate(TEXTS):
        assert (found[1_000_000 + i] == "und") == (not any(map(str.isalpha, t or "")))
    assert language_id.identify(empty(spark)).count() == 0
    unlabelled = documents(spark, ["some text"]).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert [(r.lang_pred, r.score) for r in language_id.identify(unlabelled).collect()] == [("und", 0.0)]
    df = awkward(spark)
    kept = language_id.keep(df)
    assert kept.columns == df.columns and kept.where("text is null").count() == 0
    assert LONG in {r.text for r in kept.collect()}


def test_texts_that_match_no_profile_are_rejected(spark):
    import corpus_pipeline

    docs = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    n = docs.columns.index("text")
    base = list(docs.limit(1).first())
    texts = ["Привет мир как дела", "καλημέρα κόσμε " * 40, "日本語の文章です。" * 30, "Zażółć gęślą jaźń wczoraj poszliśmy szybko przez most " * 20, "xq zvk jjw qqz wxk " * 60]
    ids = [10**9 + i for i in range(len(texts))]
    more = spark.createDataFrame([tuple(i if c == "doc_id" else None if c == "lang" else t if k == n else base[k] for k, c in enumerate(docs.columns)) for i, t in zip(ids, texts, strict=True)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(more), "").collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_the_pipeline_learns_languages_from_all_documents(spark, monkeypatch):
    texts = [(i, f"plain words about ordinary matters {'and more of them ' * (i % 7)}", "en") for i in range(300)]
    texts += [(1000 + i, f"ein paar andere Wörter über Dinge {'und noch mehr ' * (i % 5)} q{chr(97 + i % 20)}", "de") for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string").repartition(3)
    monkeypatch.setattr(language_id, "FIT_DOCS", 5)
    monkeypatch.setattr(language_id, "HELD_GRAMS", 200)
    real, seen = language_id.least_similarity, []
    monkeypatch.setattr(language_id, "least_similarity", lambda chosen, model: seen.append((chosen.count(), model.profiles, real(chosen, model))) or seen[-1][2])
    assert language_id.keep(docs).count() == 600
    known = [x for x in texts if zlib.crc32(str(x[0]).encode()) % 5]
    assert seen[0][0] == len(known)
    own = {g: language_id.ranked(language_id.grams([t for _, t, x in known if x == g])[0], language_id.PROFILE).tolist() for g in ("de", "en")}
    assert seen[0][1] == own
    model = language_id.Profiles(own, language_id.PROFILE)
    like = sorted(float(model.similarity(language_id.grams([t])[0]).max()) for _, t, _ in known)
    low = like[math.ceil(language_id.LOW * len(like)) - 1]
    assert abs(seen[0][2] - language_id.LEAST * low) < 1e-4
