import math

import pytest
from pyspark.sql import functions as F

from conftest import TINY, ids, texts
from loomtext.functions.snippets import highlight, py_highlight, snippet
from loomtext.functions.text import py_tokens
from loomtext.operators import search as S
from loomtext.operators.index import build_index, corpus_stats, integrity, merge_indexes, token_counts, top_terms
from loomtext.operators.quality import mean_precision, precision_at_k
from loomtext.operators.scoring import BM25, TfIdf, document_scores
from loomtext.sources.store import same_content

GOLD = {
    "python": ([0.280846, 0.310152, 0.346286, 0], [0.847298, 0.847298, 0.847298, 0]),
    "кіт": ([0.545785, 0, 0.969437, 0], [1.098612, 0, 1.860112, 0]),
    "café python": ([1.228856, 0.310152, 0.346286, 0], [2.456736, 0.847298, 0.847298, 0]),
    "event loop python": ([1.372417, 1.515625, 0.346286, 0], [3.044522, 3.044522, 0.847298, 0]),
}


@pytest.mark.parametrize("words", GOLD)
@pytest.mark.parametrize("which", [0, 1])
def test_golden_scores(tiny, tiny_index, words, which):
    scorer = (BM25(), TfIdf())[which]
    query = " OR ".join(words.split())
    expected = GOLD[words][which]
    for ranking in (S.rank(tiny_index, query, scorer), S.rank_documents(tiny, query, scorer), document_scores(tiny_index, scorer, words.split())):
        got = {r.doc_id: r.score for r in ranking.collect()}
        assert {d: s for d, s in enumerate(expected) if s} == pytest.approx(got, abs=1e-6)


def test_negative_terms_do_not_score(tiny_index):
    plain = {r.doc_id: r.score for r in S.rank(tiny_index, "python").collect()}
    assert {r.doc_id: r.score for r in S.rank(tiny_index, "python NOT java").collect()} == {d: plain[d] for d in (0, 2)}


def test_end_to_end(tiny_index):
    rows = S.search(tiny_index, 'python (async OR await) NOT java "event loop"').collect()
    assert [(r["rank"], r.doc_id, r.title, r.path) for r in rows] == [(1, 0, "a", "a.txt")]
    assert "[event] [loop]" in rows[0].snippet


def test_ties_and_k(tiny, tiny_index):
    top = S.best(S.rank(tiny_index, "python", TfIdf()), 2).orderBy("rank").collect()
    assert [r.doc_id for r in top] == [0, 1]
    assert S.best(S.rank(tiny_index, "python"), 0).count() == 0
    for k in (-1, True, 1.5, "3"):
        with pytest.raises(ValueError):
            S.check_k(k)
    ranked = tiny.sparkSession.createDataFrame([(8, 1.0), (2, 2.0), (7, 1.0), (1, 1.0), (9, 1.0)], "doc_id long, score double")
    assert [r.doc_id for r in S.best(ranked, 3).orderBy("rank").collect()] == [2, 1, 7]


def test_paging(tiny_index):
    page = S.search_page(tiny_index, "python", k=2, page=2).collect()
    assert [(r.total, r.pages, r["rank"], r.doc_id) for r in page] == [(3, 2, 3, 0)]
    past = S.search_page(tiny_index, "python", k=2, page=5).collect()
    assert [(r.total, r.doc_id) for r in past] == [(3, None)]


def test_scorer_arguments():
    for bad in ({"k1": 0}, {"k1": math.inf}, {"b": 1.1}, {"b": -0.1}, {"k1": math.nan}):
        with pytest.raises(ValueError):
            BM25(**bad)


def test_custom_scorer(tiny_index):
    class Count:
        def part(self, tf, df, length, n_docs, average):
            return tf

    assert {r.doc_id: r.score for r in S.rank(tiny_index, "кіт", Count()).collect()} == {0: 1.0, 2: 2.0}


def test_saturation_and_length(spark):
    docs = build_index(texts(spark, "a " * 1 + "x " * 99, "a " * 10 + "x " * 90, "a " * 90 + "x " * 10, "a x", "y")).written()
    s = {r.doc_id: r.score for r in S.rank(docs, "a").collect()}
    assert s[0] < s[1] < s[2] and s[2] - s[1] < s[1] - s[0] and s[3] > s[0]


def test_index_tables(spark, tiny, tiny_index):
    stats = corpus_stats(tiny_index).first()
    assert (stats.documents, stats.tokens, stats.average_length) == (4, 15, 3.75)
    counts = {r.term: r.cf for r in token_counts(texts(spark, "Python python café", "café Привіт", "", None)).collect()}
    assert counts == {"python": 2, "café": 2, "привіт": 1}
    assert [(r.term, r.cf) for r in top_terms(tiny_index.postings, 3).collect()] == [("python", 3), ("кіт", 3), ("event", 2)]
    assert integrity(tiny_index).where("violations > 0").count() == 0
    halves = merge_indexes([build_index(tiny.where("doc_id < 2")), build_index(tiny.where("doc_id >= 2"))])
    assert same_content(halves, tiny_index)
    with pytest.raises(ValueError):
        merge_indexes([tiny_index, tiny_index])
    with pytest.raises(ValueError):
        merge_indexes([build_index(tiny.where("doc_id < 2")), build_index(tiny.where("doc_id >= 2"), positions=False)])
    empty = corpus_stats(build_index(tiny.limit(0))).first()
    assert (empty.documents, empty.tokens, empty.average_length) == (0, 0, 0.0)


def test_integrity_finds_damage(spark, tiny_index):
    from loomtext.operators.index import Index

    bad = tiny_index.postings.withColumn("positions", F.when(F.col("term") == "кіт", F.array(F.lit(5), F.lit(5))).otherwise(F.col("positions")))
    broken = {r.rule for r in integrity(Index(tiny_index.docs, bad)).where("violations > 0").collect()}
    assert {"positions_order", "positions_count", "position_beyond_length"} <= broken


def test_sets(spark):
    mk = lambda *v: spark.createDataFrame([(x,) for x in v], "doc_id long")
    assert (ids(S.intersect(mk(1, 2, 3), mk(2, 3, 4))), ids(S.union(mk(1, 2), mk(2, 3))), ids(S.difference(mk(1, 2), mk(2)))) == ([2, 3], [1, 2, 3], [1])


@pytest.mark.parametrize("text, terms, expected", [("begin end", {"begin"}, "[begin] end"), ("begin end", {"end"}, "begin [end]"), ("hello", set(), "hello")])
def test_snippets(text, terms, expected):
    assert snippet(text, terms) == expected


def test_far_snippet():
    assert snippet("a " * 100, set()).endswith("…")
    text = "x " * 200 + "concatenate cat dog Straße café п’ять" + " y" * 200
    got = snippet(text, {"cat", "dog", "strasse", "café", "п'ять"})
    assert got.startswith("…") and got.endswith("…") and "[cat] [dog] [Straße] [café] [п’ять]" in got and "con[cat]" not in got
    assert "\n" not in snippet("a\nb", {"a"})


def test_highlight(spark):
    text = '[cat] <b> & "x" [dog\'s]'
    expected = "<mark>cat</mark> &lt;b&gt; &amp; &quot;x&quot; <mark>dog&#x27;s</mark>"
    assert spark.createDataFrame([(text,)], "s string").select(highlight(F.col("s"))).first()[0] == expected == py_highlight(text)
    assert py_highlight("[] [a [b]") == "[] [a <mark>b</mark>"


def test_precision(spark):
    results = spark.createDataFrame([(1, d, float(-d)) for d in range(10)] + [(3, 1, 1.0)], "query_id long, doc_id long, score double")
    relevant = spark.createDataFrame([(1, 0), (1, 4), (1, 5), (1, 4), (2, 7)], "query_id long, doc_id long")
    got = precision_at_k(results, relevant)
    assert {r.query_id: (r.hits, r.precision) for r in got.collect()} == {1: (2, 0.4), 2: (0, 0.0)}
    assert mean_precision(got).first().mean_precision == pytest.approx(0.2)


def test_reference_ranking_in_python(tiny_index):
    docs = [py_tokens(t) for _, _, t in TINY]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    expected = {}
    for i, d in enumerate(docs):
        s = 0.0
        for t in ("event", "кіт"):
            df, tf = sum(t in x for x in docs), d.count(t)
            s += math.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg)) if tf else 0
        if s:
            expected[i] = s
    assert {r.doc_id: r.score for r in S.rank(tiny_index, "event OR кіт").collect()} == pytest.approx(expected, rel=1e-12)
