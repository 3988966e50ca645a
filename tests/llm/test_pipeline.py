from conftest import DATA
from edge_cases import awkward
from test_near_dedup import brute
from test_tokens import check_packing

import corpus_pipeline
from sylva.llm import quality_rules, queries
from test_lines_rules_languages import plain_lines


def test_stages_against_plain_versions(spark):
    folder = str(DATA / "sf0.001")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "language_id", "line_dedup", "near_dedup", "packing"]

    good = stages["quality_rules"](spark, docs, folder)
    judged = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == judged and good.columns == docs.columns

    told = stages["language_id"](spark, good, folder)
    assert {r.doc_id for r in told.collect()} == judged and told.columns == docs.columns

    lined = stages["line_dedup"](spark, told, folder).cache()
    before, after = {r.doc_id: r.text for r in told.collect()}, {r.doc_id: r for r in lined.collect()}
    plain = plain_lines(list(before.items()))
    for i, r in after.items():
        assert r.text.count("\n") + 1 == max(1, plain[i][0] - plain[i][1]) and r.n_chars == len(r.text)

    once = stages["near_dedup"](spark, lined, folder).cache()
    assert {r.doc_id for r in once.collect()} == set(brute([(i, r.text) for i, r in after.items()]).values())
    assert once.columns == docs.columns

    packed = stages["packing"](spark, once, folder)
    n, total = check_packing(packed.collect(), [(r.doc_id, r.text) for r in once.collect()])
    assert n <= -(-total // 1024) * 1.02 + 1
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, folder)) == key(packed)


def test_stages_take_awkward_tables(spark):
    rows = awkward(spark).selectExpr("doc_id", "text", "lang", "key as source", "cast(length(text) as bigint) as n_chars")
    for some in (rows, rows.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            some = stage(spark, some, "")
        assert some.count() >= 0


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
