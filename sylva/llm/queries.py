"""One query for each operator, over its whole table with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, language_id, line_dedup, near_dedup, packing, quality_crf, quality_rules, token_files, tokenize, top_k
from .common import table


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file; the files come with an installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), carry=["page_id", "url"])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.round_trip_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(table(spark, sf_dir, "documents"), wordless=True)
    return found.select("doc_id", "class_id", "class_size", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_line_dedup,
        op3_token_files,
        op4_html_extraction,
        op5_quality_rules,
        op6_quality_classifier,
        op7_bpe_round_trip,
        op8_exact_top_k,
        op9_language_id,
        op10_near_dedup,
    )
}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": f"""
with docs as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (
  select r, doc_id, unnest(range(len(ls))) as pos, unnest(ls) as line from docs),
keyed as (
  select *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
common as (
  select k, max(doc_id) as owner from keyed where length(k) >= 40 group by k having count(distinct doc_id) + max(cast(doc_id is null as int)) >= 5),
marked as (
  select keyed.*, common.k is not null and doc_id is distinct from owner as lost from keyed left join common using (k))
select doc_id, count(*) as n_lines, count(*) filter (where lost) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) as kept_sha256
from marked group by r, doc_id""",
    "op8_exact_top_k": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v as q, v as c where q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scores)
select query_id, rank, vec_id, score from ranked where rank <= 10""",
    "op5_quality_rules": r"""
with docs as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
pos as (select doc_id, w, unnest(range(1, len(w) - 1)) as i from docs where len(w) >= 3),
tri as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from pos),
rep as (
  select doc_id, count(distinct i + j) as r from tri, (values (0), (1), (2)) as v(j) where n >= 2 group by doc_id),
m as (
  select docs.doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) as n_symbols,
    length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')) as n_capitals,
    length(t) - length(regexp_replace(t, '\p{L}+', '', 'g')) as n_letters,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls, coalesce(r, 0) as n_repeat_words
  from docs left join rep using (doc_id)),
f as (select *, len(ls) - len(list_distinct(ls)) as n_dup_lines, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or 100 * n_capitals > 40 * n_letters or 100 * n_letters < 50 * word_chars
    or word_chars < 3 * n_words or word_chars > 10 * n_words or 2 * n_dup_lines > len(ls)) as kept
from f""",
}
