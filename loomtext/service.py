"""A small HTTP service over :mod:`loomtext.api`: JSON, and two plain pages to look at results and documents.

``GET /search?q=&k=&page=&scorer=&mode=``, ``/docs/{id}``, ``/stats``, ``/health``; ``/`` with the same parameters and
``/doc/{id}`` as HTML. Wrong parameters are 422, unknown documents and paths 404, no index 503, anything else 500.
"""

from __future__ import annotations

import html
import json
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from loomtext import api
from loomtext.operators.index import Index
from loomtext.operators.semantic import Encoder, SemanticIndex


class Unavailable(RuntimeError):
    """There is no index to search."""


class Service:
    """Answers of the service, whatever transports them: :meth:`answer` gives status, content type and body."""

    def __init__(self, index: Index | None, semantic: SemanticIndex | None = None, encoder: Encoder | None = None):
        self.index, self.semantic, self.encoder = index, semantic, encoder

    def answer(self, target: str) -> tuple[int, str, str]:
        try:
            parts = urlsplit(target)
            kind, body = self._route(parts.path, dict(parse_qsl(parts.query, keep_blank_values=True)))
            return 200, kind, body
        except LookupError as e:
            status, text = 404, str(e)
        except ValueError as e:
            status, text = 422, str(e)
        except Unavailable as e:
            status, text = 503, str(e)
        except Exception:  # the boundary: what went wrong is for the log, not for the client
            status, text = 500, "internal error"
        return status, "application/json", json.dumps({"error": text}, ensure_ascii=False)

    def _route(self, path: str, raw: dict[str, str]) -> tuple[str, str]:
        to_json = lambda value: ("application/json", json.dumps(value, ensure_ascii=False, default=str))
        if path == "/health":
            return to_json(api.health(self.index))
        if self.index is None:
            raise Unavailable("no index")
        if path == "/search":
            return to_json(asdict(self._search(raw)))
        if path == "/stats":
            return to_json(api.stats(self.index))
        if path == "/":
            return "text/html; charset=utf-8", self._results(raw)
        name, _, number = path.strip("/").partition("/")
        if name in ("docs", "doc") and number.isdigit():
            found = api.document(self.index, int(number))
            return to_json(found) if name == "docs" else ("text/html; charset=utf-8", _page(found["title"] or "", f"<pre>{html.escape(found['text'] or '')}</pre>"))
        raise LookupError(f"nothing at {path}")

    def _search(self, raw: dict[str, str]) -> api.SearchResponse:
        return api.execute_search(self.index, api.SearchParams.read(raw), self.semantic, self.encoder)

    def _results(self, raw: dict[str, str]) -> str:
        q = html.escape(raw.get("q", ""))
        form = f'<form><input name="q" value="{q}"><button>Search</button></form>'
        if not raw.get("q"):
            return _page("Search", form)
        found = self._search(raw)
        rows = "".join(f'<li><a href="/doc/{r["doc_id"]}">{html.escape(r["title"] or "")}</a><p>{r["html"]}</p></li>' for r in found.results)
        return _page(raw["q"], f"{form}<p>{found.total}</p><ol>{rows}</ol>")


def _page(title: str, body: str) -> str:
    return f"<!doctype html><html><head><meta charset=utf-8><title>{html.escape(title)}</title></head><body>{body}</body></html>"


def make_server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, kind, body = service.answer(self.path)
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(index: Index, host: str, port: int) -> None:
    make_server(Service(index), host, port).serve_forever()
