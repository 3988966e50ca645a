import random
import re

import numpy as np
import pytest
from conftest import DATA
from edge_cases import TEXTS, awkward, documents, empty

from sylva.llm import near_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text):
    w = WORDS.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs, similarity=0.8):
    sets = {i: sets_of(t) for i, t in docs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if n >= similarity * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: root(i) for i in ids}


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"new{r.randrange(10**9)}"
    return " ".join(words)


def test_shingles_match_plain_sets():
    texts = ["a b c d e f", "a b c d", "", "a b c d e f a b c d e f", " a\tb\nc d e f ", "x y z", "x y  z"]
    found = near_dedup.shingles(texts)
    assert [len(s) for s, _ in found] == [len(sets_of(t)) for t in texts]
    assert (found[0][0] == found[4][0]).all() and (found[5][0] == found[6][0]).all()
    assert found[3][1].sum() == 8 and not set(found[0][0]) & set(found[1][0])


def probability_jaccard(x, y):
    keys = set(x) | set(y)
    total = 0.0
    for d in set(x) & set(y):
        total += 1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in keys)
    return total


@pytest.mark.parametrize("seed", range(4))
def test_signatures_estimate_probability_jaccard(seed):
    r = random.Random(seed)
    a = {i: r.choice([1, 2, 5]) for i in range(40)}
    b = {i: r.choice([1, 2, 5]) for i in range(10, 55)} | {i: a[i] for i in range(15, 35)}
    pack = lambda x: (near_dedup.mix(np.array(sorted(x), np.uint64) + np.uint64(seed * 1000)), np.array([x[i] for i in sorted(x)]))
    one, two = near_dedup.signatures([pack(a), pack(b)], 4000)
    weight = lambda x: {k: 1 + np.log(v) for k, v in x.items()}
    assert abs((one == two).mean() - probability_jaccard(weight(a), weight(b))) < 0.04


def test_a_signature_does_not_depend_on_the_batch():
    texts = [" ".join(f"w{(i * k) % 97}" for i in range(n)) for k, n in enumerate([3, 50, 400, 9, 1, 0], 1)]
    sets = near_dedup.shingles(texts)
    together = near_dedup.signatures(sets, 125)
    assert all((near_dedup.signatures([s], 125)[0] == row).all() for s, row in zip(sets, together, strict=True))


@pytest.mark.parametrize("seed", range(2))
def test_classes_against_brute_force(spark, seed):
    r = random.Random(seed)
    docs = []
    for _ in range(12):
        words = [f"w{r.randrange(4000)}" for _ in range(r.randint(30, 160))]
        docs += [edited(r, words, r.choice([0, 0, 1, 2, 3, 5, 8])) for _ in range(r.randint(1, 9))]
    docs += ["a b", "a b", "a  b", "", "", None, "b a"]
    r.shuffle(docs)
    found = near_dedup.classes(documents(spark, docs)).collect()
    expected = brute(list(enumerate(docs)))
    assert {x.doc_id: x.class_id for x in found} == expected
    assert sorted(x.doc_id for x in found if x.kept) == sorted(set(expected.values()))
    sizes = {c: list(expected.values()).count(c) for c in expected.values()}
    assert all(x.class_size == sizes[x.class_id] for x in found)


def test_a_large_group_with_members_of_its_own(spark):
    """Most copies hang together, some have too many edits to be linked to anything."""
    r = random.Random(7)
    words = [f"w{i}" for i in range(150)]
    docs = [edited(r, words, r.choice([0, 1, 2, 3, 4, 5, 6, 9])) for _ in range(250)]
    docs.sort(key=lambda _: r.random())
    assert {x.doc_id: x.class_id for x in near_dedup.classes(documents(spark, docs)).collect()} == brute(list(enumerate(docs)))


def test_near_copies_with_repeated_passages(spark):
    """Pairs that the plain similarity accepts although repetition in one of them makes the weighted one low."""
    r = random.Random(3)
    docs = []
    for _ in range(100):
        words, line = [f"w{r.randrange(10**9)}" for _ in range(104)], [f"x{r.randrange(10**9)}" for _ in range(16)]
        docs += [" ".join(words), " ".join(words + line * 30)]
    expected = brute(list(enumerate(docs)))
    assert sum(i != c for i, c in expected.items()) == 100
    assert {x.doc_id: x.class_id for x in near_dedup.classes(documents(spark, docs)).collect()} == expected


def template_texts(r, n=160):
    """Families of documents with frequent passages and parts of their own, on both sides of the similarity."""
    common = [f"c{i}" for i in range(140)]
    other = common[:70] + [f"d{i}" for i in range(70)]
    return [" ".join(r.choice([common, common, other]) + [f"o{i}x{k}" for k in range(r.choice([0, 4, 8, 11, 12, 13, 14, 15, 16, 17, 20, 30, 36]))]) for i in range(n)]


@pytest.mark.parametrize("frequent", [2, 10**9])
@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_templates_by_every_way_of_joining(spark, monkeypatch, frequent, broadcast):
    monkeypatch.setattr(near_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(near_dedup, "BROADCAST_NODES", broadcast)
    docs = template_texts(random.Random(frequent))
    expected = brute(list(enumerate(docs)))
    assert 10 < len(set(expected.values())) < len(docs)
    assert {x.doc_id: x.class_id for x in near_dedup.classes(documents(spark, docs)).collect()} == expected


@pytest.mark.parametrize("most, joins", [(2_000_000, 1), (0, 3)])
def test_few_pairs_move_no_more_sets_than_they_need(spark, monkeypatch, most, joins):
    plans, real = [], near_dedup.stored
    monkeypatch.setattr(near_dedup, "BROADCAST_PAIRS", most)
    monkeypatch.setattr(near_dedup, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or real(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = spark.createDataFrame([(i, list(range(10 + i % 3))) for i in range(30)], "node bigint, shingles array<bigint>")
        pairs = spark.createDataFrame([(a, b) for b in range(1, 30) for a in (0, b - 1)], "a bigint, b bigint").distinct()
        found = {tuple(r) for r in near_dedup._verified(pairs, sets, 0.9).collect()}
        one = dict(plans)["linked"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {(a, b) for b in range(1, 30) for a in (0, b - 1) if abs(a % 3 - b % 3) < 2}
    assert one.count("SortMergeJoin") == joins


def test_ranges_cover_sizes_once(spark):
    F = near_dedup.F
    spans = spark.createDataFrame([(a, a + w, 0.25 * (a + w) + 1) for a in (1, 2, 7, 64, 125, 999) for w in (1, 2, 3, 16, 31, 33)], "a int, b int, c double")
    found = spans.withColumn("at", F.explode(near_dedup._ranges(F.col("a"), F.col("b")))).collect()
    for a, b in {(r.a, r.b) for r in found}:
        held = [p for r in found if (r.a, r.b) == (a, b) for p in range(r["at"].pos << r["at"].level, (r["at"].pos + 1) << r["at"].level)]
        assert sorted(held) == list(range(a, b))
    above = spark.createDataFrame([(13, 4.0)], "n int, c double").select(near_dedup._above("n", F.col("c")).alias("x")).first().x
    assert [tuple(v) for v in above] == [(0, 13), (1, 6), (2, 3), (3, 1)]


def test_a_frequent_passage_makes_no_pairs(spark, monkeypatch):
    """Documents of one template, none near another: the joins form no pairs, whatever their number."""
    common, made = [f"c{i}" for i in range(140)], []
    real = near_dedup._prefix_pairs
    monkeypatch.setattr(near_dedup, "_prefix_pairs", lambda *a: made.append(real(*a)) or made[-1])
    docs = [" ".join(common + [f"o{i}x{k}" for k in range(20)]) for i in range(400)]
    assert {x.class_size for x in near_dedup.classes(documents(spark, docs)).collect()} == {1}
    assert len(made) == 1 and made[0].count() == 0


def test_components_of_paths_and_stars(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(200, 300), (300, 250)]
    r.shuffle(pairs)
    edges = spark.createDataFrame([(a, b) if r.random() < 0.5 else (b, a) for a, b in pairs], "a bigint, b bigint")
    for most in (near_dedup.LOCAL_EDGES, 0):
        found = {x.node: x.root for x in near_dedup.components(edges, most).collect()}
        assert found == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)} | {300: 200, 250: 200}


def test_awkward_tables(spark):
    df = awkward(spark)
    found = near_dedup.classes(df).collect()
    assert len(found) == df.count()
    by_id = {}
    for x in found:
        by_id.setdefault(x.doc_id, []).append(x)
    assert all(x.class_size == 1 and x.kept for i in (0, 1, 2, 7) for x in by_id[i])
    assert sorted(x.kept for x in by_id[3]) == [False, True] and by_id[None][0].kept
    kept = near_dedup.keep(df)
    assert kept.columns == df.columns and kept.count() == sum(x.kept for x in found)
    assert near_dedup.classes(empty(spark)).count() == near_dedup.keep(empty(spark)).count() == 0
    assert near_dedup.keep(documents(spark, TEXTS[3:5])).count() == 2


def test_equal_texts_without_words(spark):
    import corpus_pipeline

    df = documents(spark, ["", "a b", None, " ", "", " ", "\n", "a b", ""])
    found = near_dedup.classes(df, wordless=True).collect()
    assert {x.doc_id: (x.class_id, x.class_size) for x in found} == {0: (0, 4), 1: (1, 2), 2: (0, 4), 3: (3, 2), 4: (0, 4), 5: (3, 2), 6: (6, 1), 7: (1, 2), 8: (0, 4)}
    assert sorted(x.doc_id for x in found if x.kept) == [0, 1, 3, 6]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [0, 1, 3, 6]


def test_query_on_the_smallest_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).collect()]
    from sylva.llm.queries import op10_near_dedup

    assert {x.doc_id: x.class_id for x in op10_near_dedup(spark, str(DATA / "sf0.001")).collect()} == brute(docs)


def test_idle_workers_forget_powers(spark, monkeypatch):
    import pyarrow as pa

    made, real = [], near_dedup.lean
    monkeypatch.setattr(near_dedup, "lean", lambda *a: made.append(real(*a)) or made[-1])
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    near_dedup._digests(docs, near_dedup.F.col("text"), 25, 5)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"x"]), pa.array(["some words " * 1000])], ["doc_id", "md5", "text"])
    assert sum(x.num_rows for x in made[0](iter([batch]))) == 1
    assert [len(x) for x in near_dedup._powers] == [1, 1]
