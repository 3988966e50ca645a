import html as entities
import itertools
import random
import re

import numpy as np
import pytest
from conftest import DATA
from edge_cases import TEXTS, awkward, documents, empty

from sylva.llm import html_text, quality_crf, top_k

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><div id="cookie-notice"><p>We use cookies to make this site better for you. Accept them all now.</p></div>
<header class="site-header"><h2>Site</h2><a href=/>Home</a></header><nav><ul><li><a href=1>One</a></li></ul></nav>
<div class="layout"><div class="sidebar"><h3>Popular</h3><ul><li><a href=1>A story</a><li><a>Two</a></ul></div>
<div class="content"><h1>Headline here</h1><p>First paragraph, with <a href="x>y">a link</a> &amp; more text.<p>Second &lt;one&gt;&nbsp;here,<br>short.
<div class="ad">Buy now! It is great and cheap, really, and you will like it.</div><!-- <p>gone</p> --><p>Third para<b>graph</b> goes on.</p><ul><li>item one</li><li>item two</li></ul>
<form action=x><p>Your email</p><input><button>Go</button></form><script>var t="</p><p>no";</script></div>
<section class="commentList"><h3>Comments</h3><div><p>I liked this article, it was long and detailed and of help to me, thank you.</p></div></section></div>
<aside><p>Something at the side that nobody reads, though it has many words in it.</p></aside><footer><p>Copyright, all rights reserved, do not copy any of this.</p></footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE).split("\n\n") == ["Headline here", "First paragraph, with a link & more text.", "Second <one> here, short.", "Third paragraph goes on.", "item one", "item two"]


PLAIN = """<html><body class="single comments-open has-sidebar"><div id="top-menu"><a>One</a> <a>Two</a></div><main class="content with-sidebar"><header class="entry-header"><h1>Title</h1></header>
<div class="entry-content"><p>One paragraph of words that say something.</p><p><a href=x>Only a link in here</a></p><p>Yes.</p><div class="newsletter-signup"><p>Sign up for our letter and get more of this each week.</p></div>
<blockquote>Quoted.</blockquote></div></main><div id="comments"><ol class="commentlist"><li><article class="comment"><p>A reader has a lot to say about this, and says it here.</p></article></li></ol></div>
<div class="siteFooter">About us</div></body></html>"""


def test_main_text_of_a_page_without_article():
    assert html_text.main_text(PLAIN).split("\n\n") == ["Title", "One paragraph of words that say something.", "Only a link in here", "Yes.", "Quoted."]
    assert html_text.main_text("<p>Bare.</p>\n<p>Two paragraphs with a few words each, no more.</p>") == "Bare.\n\nTwo paragraphs with a few words each, no more."


@pytest.mark.parametrize("page", ["", "<", "<p", "a < b > c", "<p>x</b></p", "<!-- open", "<script>x", "</p></p>", "<a title='>'>x</a>", "<p>&#x41;&bogus;&am</p>", "\x00<b>퟿</b>", "<div " + "x='" * 500])
def test_broken_markup(page):
    assert isinstance(html_text.main_text(page), str)
    assert html_text.main_text("<article><p>Some words.</p><p>a < b, 1<2</p>").endswith("a < b, 1<2")


@pytest.mark.parametrize("seed", range(60))
def test_cut_is_minimal(seed):
    r = random.Random(seed)
    n = r.randint(1, 9)
    lean = [r.choice([-3, -2, -1, -0.5, 0, 0.5, 1, 2, 3]) for _ in range(n)]
    joined = {(i, j): r.choice([0.5, 1, 2]) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5}
    cost = lambda s: sum(max(0, -x) if a else max(0, x) for x, a in zip(lean, s, strict=True)) + sum(w for (i, j), w in joined.items() if s[i] != s[j])
    best = min(map(cost, itertools.product([False, True], repeat=n)))
    assert cost(html_text.min_cut(lean, joined)) == pytest.approx(best)
    assert cost(html_text.max_flow(lean, [(a, b, w, w) for (a, b), w in joined.items()])) == pytest.approx(best)


@pytest.mark.parametrize("seed", range(40))
def test_cut_with_one_way_edges_is_minimal(seed, monkeypatch):
    r = random.Random(100 + seed)
    n = r.randint(2, 9)
    lean = [r.choice([-3, -2, -1, -0.5, 0, 0.5, 1, 2, 3]) for _ in range(n)]
    joined = {(i, j): r.choice([0.5, 1, 2]) for i in range(n) for j in range(i + 1, n) if r.random() < 0.3}
    oneway = {(i, j): r.choice([0.5, 1, 2]) for i in range(n) for j in range(n) if i != j and r.random() < 0.3}
    cost = lambda s: sum(max(0, -x) if a else max(0, x) for x, a in zip(lean, s, strict=True)) + sum(w for (i, j), w in joined.items() if s[i] != s[j]) + sum(w for (i, j), w in oneway.items() if s[i] and not s[j])
    assert cost(html_text.min_cut(lean, joined, oneway)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


def test_the_cut_turns_blocks(spark):
    """On real pages the text alone would keep adverts and footers; the graph turns them, and keeps every block of the article, with or without its tag."""
    pages = spark.read.parquet(str(DATA / "sf0.01/pages.parquet"))
    model = html_text.fit(pages)
    assert model != html_text.DEFAULT
    turned = total = 0
    for r in pages.collect():
        inside = r.html.split("<article>")[1].split("</article>")[0]
        expected = [b.text for b in html_text.blocks(inside)]
        for page in (r.html, r.html.replace("<article>", "<div>").replace("</article>", "</div>")):
            found = html_text.blocks(page)
            keep = html_text.labels(found, model)
            assert [b.text for b, yes in zip(found, keep, strict=True) if yes] == expected
            turned += sum((x > 0) != yes for x, yes in zip(html_text.leaning(found, model), keep, strict=True))
            total += len(found)
    assert turned > 0.01 * total


def test_flow_decides_where_neighbours_disagree(monkeypatch):
    calls = []
    real = html_text.max_flow
    monkeypatch.setattr(html_text, "max_flow", lambda *a: calls.append(len(a[0])) or real(*a))
    texts = ["Yes.", "A few words here, no more.", "No.", "A few words here, no more.", "Well, there are some more here."]
    page = "<body>" + "".join(f"<p>{x}</p>" for x in texts)
    assert len(html_text.main_text(page).split("\n\n")) == len(texts)  # together, though two lean the other way
    assert calls and [x > 0 for x in html_text.leaning(html_text.blocks(page))] == [False, True, False, True, True]


def test_names_of_a_container_do_not_save_what_lies_in_a_sidebar():
    page = "<main><p>One paragraph that has enough words to be content here.</p><div class=sidebar><div class=content>" + "<p>Another one at the side that reads like any content.</p>" * 30 + "</div></div></main>"
    assert html_text.main_text(page) == "One paragraph that has enough words to be content here."


@pytest.mark.parametrize("make", [lambda n: "<span>" * n + "x</div>" * n, lambda n: "<b><div>" + "<span>y" * n + "</b>" * n, lambda n: "<p><button>" + "<span>" * n + "x<hr>" * n, lambda n: "<div>z" * n, lambda n: "<ul>" + "<li>q" * n, lambda n: '<div class="content"><div class="ad">x' * n])
def test_broken_markup_takes_time_in_proportion(make):
    import time

    began = time.process_time()
    html_text.main_text(make(40_000))
    assert time.process_time() - began < 15  # a scan of the open tags for each tag would take minutes


def test_pages_of_the_smallest_table(spark):
    pages = spark.read.parquet(str(DATA / "sf0.001/pages.parquet"))
    found = {r.page_id: r for r in html_text.extract(pages, carry=["page_id", "url"]).collect()}
    for p in pages.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", p.html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", inside))]
        r = found[p.page_id]
        assert (r.url, r.text, r.n_chars) == (p.url, "\n\n".join(x for x in parts if x), len(r.text))


def test_extraction_of_awkward_tables(spark):
    rows = [(1, None, "u", "x", 5), (1, None, "u", "x", 5), (2, "", None, "y", 6), (None, PAGE, "v", "z", 7), (3, "<p>" + "many words here. " * 50_000, "w", "z", 8)]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, url string, text string, n_chars int")
    found = sorted(html_text.extract(pages).collect(), key=repr)
    assert len(found) == 5 and sum(r.n_chars == 0 and r.text == "" for r in found) == 3
    assert max(r.n_chars for r in found) == 50_000 * 17 - 1
    assert html_text.extract(pages.limit(0)).count() == 0


def chain(unary, change):
    """Marginals and log normaliser by listing all labellings."""
    n, good, total, pairs = len(unary), np.zeros(len(unary)), 0.0, np.zeros((2, 2))
    for s in itertools.product([0, 1], repeat=n):
        p = np.exp(sum(u for u, x in zip(unary, s, strict=True) if x) + sum(change[a, b] for a, b in itertools.pairwise(s)))
        total += p
        good += p * np.array(s)
        for a, b in itertools.pairwise(s):
            pairs[a, b] += p
    return good / total, pairs / total, np.log(total)


def test_forward_backward_against_brute_force():
    r = np.random.default_rng(5)
    counts = np.array([3, 1, 7, 2])
    unary, change = r.normal(0, 2, counts.sum()), r.normal(0, 1, (2, 2))
    good, pairs, norm = quality_crf.forward_backward(unary, counts, change)
    parts = [chain(u, change) for u in np.split(unary, np.cumsum(counts)[:-1])]
    assert np.allclose(good, np.concatenate([p[0] for p in parts]))
    assert np.allclose(pairs, sum(p[1] for p in parts)) and norm == pytest.approx(sum(p[2] for p in parts))


@pytest.mark.parametrize("counts", [[150, 3, 1], [200], [90, 90, 2], [66, 2]])
def test_long_texts_are_walked_alone_with_the_same_result(counts, monkeypatch):
    r = np.random.default_rng(sum(counts))
    unary, change = r.normal(0, 2, sum(counts)), r.normal(0, 1, (2, 2))
    alone = []
    real = quality_crf._long_tail
    monkeypatch.setattr(quality_crf, "_long_tail", lambda *a: alone.append(a[0]) or real(*a))
    good, pairs, norm = quality_crf.forward_backward(unary, np.array(counts), change)
    # twice the same text is never alone
    twice = quality_crf.forward_backward(np.concatenate([unary, unary]), np.array(counts * 2), change)
    assert np.allclose(good, twice[0][: len(good)]) and np.allclose(2 * pairs, twice[1]) and 2 * norm == pytest.approx(twice[2])
    assert len(alone) == (counts[0] != 90)


def test_constrained_shares():
    r = np.random.default_rng(2)
    counts, labels = np.array([4, 1, 9, 6]), np.array([1, 0, 0, 1])
    unary, lengths = r.normal(0, 3, 20), r.integers(1, 90, 20)
    good, pairs = quality_crf.constrained(unary, lengths, counts, np.zeros((2, 2)), labels)
    for k, (g, n) in enumerate(zip(np.split(good, np.cumsum(counts)[:-1]), np.split(lengths, np.cumsum(counts)[:-1]), strict=True)):
        share = (g * n).sum() / n.sum()
        assert share >= quality_crf.GOOD_SHARE - 1e-9 if labels[k] else share <= quality_crf.BAD_SHARE + 1e-9
    assert pairs.sum() == pytest.approx((counts - 1).sum())


def test_lines_have_labels_of_their_own(spark):
    """A document of good and bad lines gets both labels, and a line's probability depends on the lines around it."""
    docs, labels = (spark.read.parquet(str(DATA / f"sf0.01/{n}.parquet")) for n in ("documents", "labels"))
    crf = quality_crf.fit(docs, labels)
    rows = docs.join(labels, "doc_id").where("text is not null and quality = 1 and text like '%\n%'").limit(20).collect()
    good = [x for r in rows for x in r.text.split("\n") if len(x) > 60][:12]
    bad = [" | ".join(x.split()) for x in good]
    both, _, _ = crf.lines(["\n".join(good[:6] + bad[6:])])
    assert (both[:6] > 0.5).mean() > 0.8 and (both[6:] < 0.5).mean() > 0.8
    turned, _, _ = crf.lines(["\n".join(x for pair in zip(good[:6], bad[6:], strict=True) for x in pair)])
    assert np.abs(turned[::2] - both[:6]).max() > 0.01
    scores = crf.score(["\n".join(good), "\n".join(bad)])
    assert scores[0] > 0.5 > scores[1]


def test_learning_takes_documents_within_its_budget(spark):
    texts = ["word and more. " * 20, "a | b | c | " * 20] * 30 + ["word " * 100_000]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(len(texts))], "doc_id bigint, quality int, toxic int")
    for most in (10_000, 10_000_000, 10):
        assert quality_crf.fit(docs, labels, fit_chars=most).weights.shape == (quality_crf.N_FEATURES,)


def test_lbfgs_finds_the_minimum():
    a = np.diag([1.0, 10, 100])
    p = quality_crf.lbfgs(lambda x: (0.5 * (x - 1) @ a @ (x - 1), a @ (x - 1)), np.zeros(3), 100)
    assert np.allclose(p, 1, atol=1e-2)


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(str(DATA / f"sf0.01/{n}.parquet")) for n in ("documents", "labels"))
    found = quality_crf.score(docs, labels)
    assert found.count() == docs.count() and found.where("score between 0 and 1").count() == docs.count()
    known = found.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in known) >= 0.97 * len(known)
    good, bad = ([r.score for r in known if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.98


def test_quality_of_awkward_tables(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(TEXTS))] + [(None, 1, 0), (3, None, 0), (4, 1, 0), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    df = awkward(spark)
    found = quality_crf.score(df, labels).collect()
    assert len(found) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert quality_crf.score(empty(spark), labels).count() == 0
    none = quality_crf.score(documents(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def plain_top(rows, k=10, every=100):
    out = []
    ok = {i: np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(int) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q, v in ok.items():
        if q % every == 0:
            scores = sorted(((-int(v @ w), i) for i, w in ok.items() if i != q and len(w) == len(v)))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    r = random.Random(6)
    rows = [(i, [r.uniform(-1, 1) for _ in range(5)]) for i in range(700)]
    rows += [(700 + i, [0.5] * 5) for i in range(300)]  # ties
    rows += [(2000, None), (2001, [None] * 5), (2002, [float("nan")] * 5), (2003, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, [0.1] * 5), (2100, [0.2, 0.3]), (2101, [0.2, 0.3]), (2200, []), (2201, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    assert sorted(map(tuple, top_k.search(df).collect())) == plain_top(rows)
    assert top_k.search(df.limit(0)).count() == 0


def test_repeated_ids_count_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), *[(1, [0.9, 0.1])] * 30, (2, [0.1, 0.1]), (3, [0.8, 0.0])]
    found = top_k.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), k=3).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(found, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 3), (0, 3, 2)]


def test_queries_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 8)
    r = random.Random(8)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(1500)]
    assert sorted(map(tuple, top_k.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect())) == plain_top(rows)


def test_vectors_with_clashing_columns_of_mixed_size_and_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(top_k, "CHUNK", 64)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    r = random.Random(9)
    rows = [(i, [r.choice([-1e3, -1.0, 0.0, 1e-3, 1e6]) for _ in range(r.choice([3, 4]))]) for i in range(900)]
    made = [(*x, 1, "v", 2.0, [1.0], 3, "n") for x in rows]
    df = spark.createDataFrame(made, "vec_id bigint, embedding array<double>, query_id int, codes string, score double, vector array<double>, place int, ids string")
    try:
        found = sorted(map(tuple, top_k.search(df).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == plain_top(rows)


def test_a_vector_of_a_third_of_all_rows(spark, monkeypatch):
    kept = []
    real = top_k._few_copies
    monkeypatch.setattr(top_k, "_few_copies", lambda *a: kept.append(real(*a)) or kept[-1])
    r = random.Random(10)
    rows = [(i, [0.9, 0.8, 0.7] if i % 3 == 0 else [r.uniform(-1, 1) for _ in range(3)]) for i in range(1500)]
    found = sorted(map(tuple, top_k.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()))
    assert found == plain_top(rows) and kept[0].count() == 1000 + 11


def test_bounds_hold_and_few_exact_vectors_are_read(spark):
    x = np.floor(1024 * np.random.default_rng(3).uniform(-1, 1, (2000, 24)))
    cells = top_k.Cells(x.min(0), x.max(0))
    middle, radius = cells.bounds(x[:40], cells.codes(x))
    score = x[:40] @ x.T
    assert (np.abs(score - middle) <= radius[:, None]).all()
    own = np.arange(40)[:, None] == np.arange(2000)[None, :]
    q, c = top_k.survivors(middle, radius, own, np.arange(2000), 10)
    assert len(q) < 40 * 60
    for i in range(40):
        best = np.argsort(np.where(own[i], -np.inf, score[i]))[-10:]
        assert set(best.tolist()) <= set(c[q == i].tolist())
