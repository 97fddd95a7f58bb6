import logging

import pytest

from loomtext import api
from loomtext.operators.semantic import HashingEncoder, SemanticIndex
from loomtext.timing import timed


def test_parameters():
    assert api.SearchParams.read({"q": "python", "k": "3", "page": "2", "scorer": "tfidf"}) == api.SearchParams("python", 3, 2, "tfidf")
    bad = [{}, {"q": " "}, {"q": "a" * 301}, {"q": "a", "k": "0"}, {"q": "a", "k": "101"}, {"q": "a", "k": "x"}, {"q": "a", "page": "10001"}, {"q": "a", "more": "1"}, {"q": "a", "mode": "x"}, {"q": "a", "scorer": "x"}]
    for raw in bad:
        with pytest.raises(ValueError):
            api.SearchParams.read(raw)


def test_pages(tiny_index):
    first = api.execute_search(tiny_index, api.SearchParams("python", k=2))
    assert (first.total, first.pages, [r["doc_id"] for r in first.results]) == (3, 2, [2, 1])
    assert first.results[0]["html"].startswith("<mark>Python</mark>")
    second = api.execute_search(tiny_index, api.SearchParams("python", k=2, page=2))
    assert [(r["rank"], r["doc_id"]) for r in second.results] == [(3, 0)]
    past = api.execute_search(tiny_index, api.SearchParams("python", k=2, page=9))
    assert (past.total, past.pages, past.results) == (3, 2, [])
    with pytest.raises(ValueError):
        api.execute_search(tiny_index, api.SearchParams("python AND"))


def test_semantic_pages(tiny_index):
    sem = SemanticIndex.build(tiny_index, HashingEncoder(32))
    got = api.execute_search(tiny_index, api.SearchParams("event loop", mode="hybrid", k=2), sem, HashingEncoder(32))
    assert len(got.results) == 2 and got.total == 3  # the empty document has neither words nor passages


def test_lookups(tiny_index):
    assert api.document(tiny_index, 1)["path"] == "b.txt"
    with pytest.raises(LookupError):
        api.document(tiny_index, 77)
    assert api.stats(tiny_index, 1)["top"] == [("python", 3)] and api.stats(tiny_index)["documents"] == 4
    assert api.health(tiny_index) == {"status": "ok", "documents": 4} and api.health(None)["status"] == "unavailable"


def test_timed(caplog):
    @timed
    def f():
        raise KeyError

    with caplog.at_level(logging.DEBUG, "loomtext"), pytest.raises(KeyError):
        f()
    assert "took" in caplog.text


def test_service(tiny_index):
    import json
    import threading
    from urllib.error import HTTPError
    from urllib.request import urlopen

    from loomtext.service import Service, make_server

    server = make_server(Service(tiny_index), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        got = json.load(urlopen(f"{at}/search?q=python&k=2"))
        assert got["total"] == 3 and [r["doc_id"] for r in got["results"]] == [2, 1]
        assert json.load(urlopen(f"{at}/docs/1"))["path"] == "b.txt" and json.load(urlopen(f"{at}/health"))["status"] == "ok"
        assert "<mark>Python</mark>" in urlopen(f"{at}/?q=python").read().decode() and "<form>" in urlopen(at).read().decode()
        assert "Python java" in urlopen(f"{at}/doc/1").read().decode() and json.load(urlopen(f"{at}/stats"))["documents"] == 4
        for path, status in (("/search?q=", 422), ("/search?q=a&more=1", 422), ("/docs/99", 404), ("/none", 404)):
            with pytest.raises(HTTPError) as e:
                urlopen(at + path)
            assert e.value.code == status
    finally:
        server.shutdown()
    assert Service(None).answer("/search?q=a")[0] == 503 and Service(None).answer("/health")[0] == 200 and Service(object()).answer("/stats")[0] == 500
