import asyncio
import json
import random
import sys
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import texts
from loomtext.cli import main
from loomtext.functions import vectors, web
from loomtext.operators import semantic as M
from loomtext.operators.index import build_index, document_frequency, fingerprint
from loomtext.operators.scoring import BM25
from loomtext.operators.search import rank
from loomtext.plans.query import any_of
from loomtext.sources import corpus, crawl, store
from loomtext.streaming import ingest


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class AsyncEncoder:
    def encode(self, values):
        out = np.zeros((len(values), 8), np.float32)
        out[:, 0] = 1
        out[:, 1] = [3 if "async" in v.lower() else 0 for v in values]
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def test_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<float>")
    assert df.select(vectors.normalize(F.col("v"))).first()[0] == pytest.approx([0.6, 0.8])
    for bad in ([0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0]):
        with pytest.raises(Exception, match="norm"):
            spark.createDataFrame([(bad,)], "v array<double>").select(vectors.normalize(F.col("v"))).collect()


def test_semantic_rank(spark):
    rows = [(0, 1, "one", [1.0, 0.0]), (1, 1, "two", [1.0, 0.0]), (2, 2, "three", [0.0, 1.0]), (3, 3, "four", [0.6, 0.8])]
    df = spark.createDataFrame(rows, "passage_id long, doc_id long, passage string, embedding array<float>")
    got = {r.doc_id: (round(r.score, 6), r.snippet) for r in M.semantic_rank(df, [1.0, 0.0]).collect()}
    assert got == {1: (1.0, "one"), 2: (0.0, "three"), 3: (0.6, "four")}
    with pytest.raises(Exception, match="length"):
        M.semantic_rank(df, [1.0]).collect()


def test_rrf(spark):
    one = spark.createDataFrame([(1, 1), (2, 2)], "doc_id long, rank long")
    two = spark.createDataFrame([(2, 1)], "doc_id long, rank long")
    assert {r.doc_id: r.score for r in M.rrf([one, two]).collect()} == {1: 1 / 61, 2: 1 / 62 + 1 / 61}


def test_ranked(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(40)], "doc_id long, score double")
    got = [r.doc_id for r in M.ranked(df).orderBy("rank").collect()]
    assert got == sorted(range(40), key=lambda i: (-(i % 5), i))


def test_modes(spark, tiny_index):
    sem = M.SemanticIndex.build(tiny_index, AsyncEncoder())
    assert sem.passages.count() == 3  # the empty document has no passage
    top = M.retrieve(tiny_index, "async", mode="semantic", semantic=sem, encoder=AsyncEncoder()).orderBy("rank").collect()
    assert top[0].doc_id == 0 and len(top) == 3
    hybrid = M.retrieve(tiny_index, "async кіт", mode="hybrid", semantic=sem, encoder=AsyncEncoder(), k=3).collect()
    lists = [M.ranked(rank(tiny_index, any_of(["async", "кіт"]), BM25())), M.ranked(sem.rank("async кіт", AsyncEncoder()).select("doc_id", "score"))]
    expected = {r.doc_id: r.score for r in M.rrf(lists).collect()}
    assert {r.doc_id: r.score for r in hybrid} == pytest.approx(expected)
    assert "[async]" in next(r.snippet for r in hybrid if r.doc_id == 0)
    for bad in ({"query": " "}, {"query": "a", "k": -1}, {"query": "a", "mode": "other"}, {"query": "a", "mode": "hybrid"}):
        with pytest.raises(ValueError):
            M.retrieve(tiny_index, **bad)


def test_embedding_files(spark, tiny_index, tmp_path):
    sem = M.SemanticIndex.build(tiny_index, AsyncEncoder())
    sem.save(str(tmp_path / "e"))
    assert M.SemanticIndex.load(spark, str(tmp_path / "e"), tiny_index, dim=8).passages.count() == 3
    other = build_index(texts(spark, "else"))
    for bad in ({"index": other}, {"dim": 9}, {"model": "x"}):
        with pytest.raises(ValueError):
            M.SemanticIndex.load(spark, str(tmp_path / "e"), **bad)
    known = M.embedding_store(sem.passages)
    again = M.embed(sem.passages.select("passage_id", "doc_id", "passage"), None, known=known)
    assert again.count() == 3
    # a resumed build encodes what is missing only: here nothing
    resumed = M.SemanticIndex.build(tiny_index, None, known=sem)
    assert resumed.passages.count() == 3 and resumed.corpus == sem.corpus
    with pytest.raises(ValueError):
        M.SemanticIndex.build(tiny_index, AsyncEncoder(), model="x", known=sem)


def test_any_document_ids(spark):
    big = 2**63 - 2
    index = build_index(spark.createDataFrame([(big, "a.txt", "one two"), (0, "b.txt", "three")], "doc_id long, path string, text string"))
    assert {r.doc_id for r in M.SemanticIndex.build(index, AsyncEncoder()).passages.collect()} == {big, 0}


def test_nearest_to_each(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (300, 4)).astype(float)
    rows = spark.createDataFrame([(i * 2, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "id long, embedding array<double>").repartition(3)
    queries = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    got = {}
    for r in M.nearest_to_each(rows, queries, "id", 4, block=7).collect():
        got.setdefault(r.query_id, {})[r.place] = r.id
    sims = x @ x.T
    expected = {i * 2: dict(enumerate([2 * j for j in sorted(range(300), key=lambda j: (-sims[i, j], j)) if j != i][:4], 1)) for i in range(0, 300, 10)}
    assert got == expected
    assert M.nearest_to_each(rows.limit(0), queries, "id").count() == 0 == M.nearest_to_each(rows, queries.limit(0), "id").count()


def test_fingerprint(spark, tiny):
    f = lambda d: fingerprint(d).first()[0]
    assert f(tiny) == f(tiny.orderBy(F.desc("doc_id")).repartition(3)) != f(tiny.where("doc_id > 0"))


URLS = {
    "HTTP://Example.COM:80/a/?z=2&a=1#x": "http://example.com/a?a=1&z=2", "https://example.com:8443/a///": "https://example.com:8443/a",
    "http://[::1]:80/x": "http://[::1]/x", "https://example.com/?a=&a=1": "https://example.com/?a=&a=1",
    "https://example.com": "https://example.com/", "http://e.com:/?b=x%20y&&a": "http://e.com/?a=&b=x+y", "http://bücher.example/%7E?q=~*é": "http://xn--bcher-kva.example/%7E?q=~%2A%C3%A9",
    " HTTP://e.com:0443//a//?=v&k=1=2\n": "http://e.com:443//a?=v&k=1%3D2", "https://e.com/a?x=%zz%C3%A9": "https://e.com/a?x=%25zz%C3%A9",
}


def test_urls(spark):
    for url, expected in URLS.items():
        assert web.py_canonical_url(url) == expected
    bad = ["mailto:a@b", "javascript:1", "file:///x", "http://", "http://a:x/", "http://u:p@a/", "http://a:99999/", "http://a:123456789012345678901234567890/", "http://@a/", "", "//a/b", "http://a b/"]
    for url in bad:
        with pytest.raises(ValueError):
            web.py_canonical_url(url)
    assert web.py_canonical_url("../b", "https://e.com/x/a") == "https://e.com/b"
    df = spark.createDataFrame([(u,) for u in [*URLS, *bad, None]], "u string")
    assert [r[0] for r in df.select(web.canonical_url("u")).collect()] == [*URLS.values(), *[None] * (len(bad) + 1)]
    assert df.select(web.origin(F.col("u"))).first()[0] == "HTTP://Example.COM:80"


def test_one_definition_of_urls(spark):
    """The expression of the JVM and the function for single values agree on whatever is put together from parts of URLs."""
    rng = random.Random(1)
    parts = ["http", "https", "ftp", "HTTPS", "://", ":", "/", "//", "@", "?", "#", "&", "=", "+", "%20", "%C3%A9", "%", "%4", ":80", ":443", ":0", ":70000", "e.com", "Ö.de", "[::1]", "a b", "x~*-_.", "\n", " ", "\\", "ж"]
    urls = ["".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(1500)]
    urls += [rng.choice(["http://", "https://e.com", "HTTP://Ö.de:80"]) + "".join(rng.choices(parts[4:], k=rng.randrange(7))) for _ in range(1500)]

    def one(url):
        try:
            return web.py_canonical_url(url)
        except ValueError:
            return None

    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(web.canonical_url("u")).collect()]
    assert [(u, g) for u, g in zip(urls, got) if g != one(u)] == []
    assert sum(g is not None for g in got) > 500
    kept = [g for g in got if g is not None and not any(map(str.isspace, g)) and not g.endswith("/")]
    assert [web.py_canonical_url(g) for g in kept] == kept


def test_html(spark):
    page = "<title>A &amp; B</title><style>x</style><p>One<b>two</b><script>no()</script></p><noscript><a href='/n'>n</a></noscript></noscript><a href='/y'>y</a>"
    expected = ("A & B", "A & B One two y", ["/y"])
    assert web.py_parse_html(page) == expected
    odd = "<!-- <a href='/c'>c</a> --><p title='x > y'>a < b &lt; c<br/>d</p><A HREF=/z data-href='/no'>z</A><img alt=\"don't\">e<script>if (a < b) '</p>'</script>f<a href='/q?a=1&amp;b=2'>"
    assert web.py_parse_html(odd) == ("", "a < b < c d z e f", ["/z", "/q?a=1&b=2"])
    assert web.py_parse_html("<p class='x>never closed <b>but</b> read") == ("", "never closed but read", []) and web.py_parse_html("") == ("", "", [])
    got = spark.createDataFrame([(page,), (None,)], "h string").select(web.parse_html("h").alias("p")).select("p.*").collect()
    assert tuple(got[0]) == expected and tuple(got[1]) == ("", "", [])


def test_retry_after():
    assert web.retry_after("3", 0) == 3 and web.retry_after("junk", 0) == 0 and web.retry_after(None, 0) == 0
    assert web.retry_after("Thu, 01 Jan 1970 00:01:00 GMT", 50) == 10 and web.retry_after("Thu, 01 Jan 1970 00:01:00 GMT", 70) == 0


def test_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("﻿Привіт".encode())
    (tmp_path / "sub/b.txt").write_text("two")
    (tmp_path / "sub/bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "c.md").write_text("no")
    got = {r.path: r.text for r in corpus.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "Привіт", "sub/b.txt": "two"}
    with pytest.raises(Exception, match="utf-8"):
        corpus.read_text_files(spark, str(tmp_path), on_error="fail").collect()
    assert corpus.read_text_files(spark, str(tmp_path), limit=1).count() == 1
    assert corpus.corpus_paths(spark, str(tmp_path)).count() == 3
    numbers = corpus.numbered(corpus.read_corpus(spark, str(tmp_path))).orderBy("doc_id").collect()
    assert [(r.doc_id, r.path) for r in numbers] == [(0, "a.txt"), (1, "sub/b.txt")]


def test_jsonl(spark, tmp_path):
    good = tmp_path / "g.jsonl"
    good.write_text('{"url": "https://e.com/a/b", "title": "T", "text": "x", "more": 1}\n\n{"url": "https://e.com/c", "title": "", "text": "y"}\n')
    assert [tuple(r) for r in corpus.read_corpus(spark, str(good)).orderBy("path").collect()] == [("/a/b", "T", "x"), ("/c", "", "y")]
    for line in ("nope", "[1]", '{"url": 1, "title": "", "text": ""}'):
        bad = tmp_path / "b.jsonl"
        bad.write_text('{"url": "u", "title": "", "text": ""}\n\n' + line)
        with pytest.raises(Exception, match="line 3"):
            corpus.read_jsonl(spark, str(bad)).collect()


def test_store(spark, tiny, tiny_index, tmp_path):
    path = str(tmp_path / "ix")
    store.save(tiny_index, path)
    assert store.same_content(store.load(spark, path), tiny_index)
    with store.open_index(spark, path) as index:
        assert "python" in index and len(index) == 9
    (tmp_path / "ix/metadata").rename(tmp_path / "gone")
    with pytest.raises(Exception):
        store.load(spark, path)


def test_scratch(spark, tiny):
    from loomtext.scratch import clear_scratch, scratch_dir, scratch_path, written

    once = written(tiny, "t")
    assert once.count() == 4 and once.schema.simpleString() == tiny.schema.simpleString()
    assert once.inputFiles()[0].split("//")[-1].lstrip("/").startswith(scratch_dir(spark).split("//")[-1].lstrip("/"))
    assert scratch_path(spark, "a") != scratch_path(spark, "a") and callable(clear_scratch)


def test_streaming_equals_batch(spark, tmp_path):
    pages = [(f"https://e.com/{i}", f"t{i}", f"word{i % 3} common", "2026-01-01T00:00:00Z") for i in range(12)]
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps(dict(zip(("url", "title", "text", "fetched_at"), p))) for p in [*pages[n * 4 : n * 4 + 4], pages[0]]))
    stream = ingest.distinct_pages(ingest.read_pages(spark, str(tmp_path / "in"), 1))
    ingest.start_indexing(stream, str(tmp_path / "ix"), str(tmp_path / "ck")).awaitTermination()
    index = ingest.load_stream(spark, str(tmp_path / "ix"))
    assert index.docs.count() == 12 and len({r.path for r in index.docs.collect()}) == 12
    assert {r.term: r.df for r in document_frequency(index.postings).collect()} == {"common": 12, "word0": 4, "word1": 4, "word2": 4}
    with pytest.raises(ValueError):
        ingest.load_stream(spark, str(tmp_path / "none"))


def test_refetched_pages_replace(spark, tmp_path):
    (tmp_path / "in").mkdir()
    fetched = [("HTTP://E.com:80/a/", "cat dog", "1"), ("http://e.com/a#x", "cat", "2"), ("http://e.com/b", "cat", "3"), ("mailto:x", "cat", "4"), ("http://e.com/a", "bird", "5")]
    for n, (url, text, at) in enumerate(fetched):
        (tmp_path / f"in/{n}.json").write_text(json.dumps({"url": url, "title": "t", "text": text, "fetched_at": at}))
        ingest.start_indexing(ingest.read_pages(spark, str(tmp_path / "in"), 1), str(tmp_path / "ix"), str(tmp_path / "ck")).awaitTermination()
    index = ingest.load_stream(spark, str(tmp_path / "ix"))
    assert {r.path: r.text for r in index.docs.collect()} == {"http://e.com/a": "bird", "http://e.com/b": "cat"}
    assert {r.term: r.df for r in document_frequency(index.postings).collect()} == {"bird": 1, "cat": 1}


def test_crawl(tmp_path):
    html = {"content-type": "text/html"}
    site = {
        "http://s.test/robots.txt": crawl.Response(200, {}, b"User-agent: *\nDisallow: /no"),
        "http://s.test/": crawl.Response(200, {"content-type": "Text/HTML; Charset=windows-1252"}, "<title>Homé</title><a href='/a/'>a</a><a href='/a#x'>a</a><a href='/no'>n</a><a href='http://o.test/'>o</a><a href='/r'>r</a><a href='/i'>i</a>".encode("cp1252")),
        "http://s.test/a": crawl.Response(200, html, b"<title>A</title>text"),
        "http://s.test/r": crawl.Response(302, {"location": "/r2"}),
        "http://s.test/r2": crawl.Response(302, {"location": "/r"}),
        "http://s.test/i": crawl.Response(200, {"content-type": "image/png"}, b"x"),
    }
    asked = []

    async def get(url):
        asked.append(url)
        return site.get(url, crawl.Response(404))

    stats = crawl.CrawlStats()
    target = tmp_path / "out.jsonl"
    with crawl.crawl_log(str(tmp_path / "log")):
        asyncio.run(crawl.collect(["http://s.test/"], str(target), get=get, delay=0.0, workers=3, stats=stats))
    assert "http://s.test/a 200" in (tmp_path / "log").read_text()
    pages = {p["url"]: p["title"] for p in map(json.loads, target.read_text().splitlines())}
    assert pages == {"http://s.test/": "Homé", "http://s.test/a": "A"} and stats.blocked == 1 and stats.pages == 2
    assert len(asked) == len(set(asked)) and not any("o.test" in u for u in asked)


def test_fetch_retries():
    replies = iter([crawl.Response(503), crawl.Response(429, {"retry-after": "0"}), crawl.Response(200)])

    async def get(url):
        return next(replies)

    async def run():
        return await crawl.fetch("http://s.test/", get, crawl.Gate(delay=0.0), base_delay=0.0)

    assert asyncio.run(run()).status == 200


def test_gate_keeps_the_distance():
    starts = []

    async def run():
        gate = crawl.Gate(total=1, per_host=5, delay=0.05)

        async def work():
            starts.append(time.monotonic())
            await asyncio.sleep(0.08)
            return crawl.Response(200)

        await asyncio.gather(*(gate.run(f"http://a.test/{i}", work) for i in range(3)), *(gate.run(f"http://b.test/{i}", work) for i in range(2)))
        gate.hold("http://a.test/", 0.2)
        at = time.monotonic()
        await gate.run("http://a.test/x", work)
        return starts[-1] - at

    assert asyncio.run(run()) >= 0.19
    assert all(b - a >= 0.049 for a, b in zip(starts, starts[1:]))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.txt").write_text("Python async event loop")
    (tmp_path / "c/b.txt").write_text("Python java")
    ix = str(tmp_path / "ix")
    assert main(["index", str(tmp_path / "c"), ix]) == 0
    assert main(["search", ix, '"event loop"', "--json"]) == 0
    assert json.loads(capsys.readouterr().out.strip())["path"] == "a.txt"
    assert main(["search", ix, "NOT async", "--boolean"]) == 0 and "b.txt" in capsys.readouterr().out
    assert main(["stats", ix, "--top", "1"]) == 0 and "python" in capsys.readouterr().out
    assert main(["stats", str(tmp_path / "c"), "--corpus", "--json", "--limit", "1"]) == 0
    assert json.loads(capsys.readouterr().out.strip())["documents"] == 1
    assert main(["embed", ix, str(tmp_path / "e"), "--dim", "16"]) == 0
    assert main(["embed", ix, str(tmp_path / "e2"), "--dim", "16", "--resume", str(tmp_path / "e")]) == 0
    assert main(["search", ix, "event", "--mode", "hybrid", "--embeddings", str(tmp_path / "e")]) == 0
    assert main(["search", ix, "("]) == 1 and capsys.readouterr().err.startswith("error:")
