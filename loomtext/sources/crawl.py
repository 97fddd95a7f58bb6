"""A polite crawler on the driver, which writes pages as JSON Lines for :func:`loomtext.sources.corpus.read_jsonl`.

Fetching waits on other machines, not on data, so it is no Spark job: a pool of asyncio workers shares one frontier. The
transport is an argument, ``get(url) -> Response``, so tests and other networks plug in; the default uses ``urllib``.
"""

from __future__ import annotations

import asyncio
import json
import logging
import queue
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import AsyncIterator, Awaitable, Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass, field
from datetime import datetime, timezone
from logging.handlers import QueueHandler, QueueListener
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

from loomtext.functions.web import py_canonical_url, py_origin, py_parse_html, retry_after

AGENT = "loomtext"
log = logging.getLogger("loomtext.crawl")


@dataclass(frozen=True)
class Response:
    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""


@dataclass(frozen=True)
class Page:
    url: str
    title: str
    text: str
    fetched_at: str


@dataclass
class CrawlStats:
    pages: int = 0
    requests: int = 0
    blocked: int = 0
    failed: int = 0


Get = Callable[[str], Awaitable[Response]]


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


async def urllib_get(url: str, timeout: float = 10, most: int = 2 << 20) -> Response:
    """One GET in a thread, without following redirects; a body over ``most`` bytes is an error."""

    def run() -> Response:
        opener = urllib.request.build_opener(_NoRedirect)
        try:
            with opener.open(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as r:
                body = r.read(most + 1)
                if len(body) > most:
                    raise ValueError("the body is too long")
                return Response(r.status, {k.lower(): v for k, v in r.headers.items()}, body)
        except urllib.error.HTTPError as e:
            return Response(e.code, {k.lower(): v for k, v in e.headers.items()})
        except urllib.error.URLError as e:
            if isinstance(e.reason, TimeoutError):
                raise TimeoutError("no connection in time") from e
            raise

    return await asyncio.to_thread(run)


class Gate:
    """At most ``total`` requests at once, ``per_host`` to one origin, and ``delay`` seconds between starts to one origin."""

    def __init__(self, total: int = 10, per_host: int = 2, delay: float = 0.2):
        self._all, self._per_host, self._delay = asyncio.Semaphore(total), per_host, delay
        self._hosts: dict[str, asyncio.Semaphore] = {}
        self._next: dict[str, float] = {}
        self._least: dict[str, float] = {}

    def slow_down(self, host: str, seconds: float) -> None:
        self._least[host] = max(self._least.get(host, self._delay), seconds)

    def hold(self, url: str, seconds: float) -> None:
        """No request to the URL's origin starts within so many seconds."""
        host = py_origin(url)
        self._next[host] = max(self._next.get(host, 0.0), time.monotonic() + seconds)

    async def run(self, url: str, work: Callable[[], Awaitable[Response]]) -> Response:
        host = py_origin(url)
        async with self._hosts.setdefault(host, asyncio.Semaphore(self._per_host)):
            while True:
                await asyncio.sleep(max(0.0, self._next.get(host, 0.0) - time.monotonic()))
                async with self._all:
                    # a start is taken only with a place among all requests, so starts keep their distance
                    now = time.monotonic()
                    if now >= self._next.get(host, 0.0):
                        self._next[host] = now + self._least.get(host, self._delay)
                        return await work()


async def fetch(url: str, get: Get, gate: Gate, attempts: int = 3, base_delay: float = 0.25) -> Response:
    """Up to ``attempts`` tries; 429, 5xx and time-outs are tried again after a growing, jittered wait, or as Retry-After asks."""
    for attempt in range(attempts):
        try:
            response = await gate.run(url, lambda: get(url))
            if response.status != 429 and response.status < 500:
                return response
            asked = retry_after(response.headers.get("retry-after"), time.time())
            gate.hold(url, asked)
        except TimeoutError:
            if attempt + 1 == attempts:
                raise
            response, asked = Response(0), 0.0
        if attempt + 1 < attempts:
            await asyncio.sleep(max(asked, min(8.0, base_delay * 2**attempt) + random.uniform(0, base_delay)))
    return response


class Robots:
    """robots.txt once per origin: none (404) allows everything, a readable one decides, anything else denies everything."""

    def __init__(self, get: Get, gate: Gate):
        self._get, self._gate, self._rules = get, gate, {}

    async def allowed(self, url: str) -> bool:
        host = py_origin(url)
        if host not in self._rules:
            self._rules[host] = asyncio.ensure_future(self._read(host))
        rules = await self._rules[host]
        return rules if isinstance(rules, bool) else rules.can_fetch(AGENT, url)

    async def _read(self, host: str) -> RobotFileParser | bool:
        try:
            response = await fetch(f"{host}/robots.txt", self._get, self._gate)
        except (OSError, ValueError, TimeoutError):
            return False
        if response.status == 404:
            return True
        if response.status != 200:
            return False
        rules = RobotFileParser()
        rules.parse(response.body.decode("utf-8", "replace").splitlines())
        if pause := rules.crawl_delay(AGENT):
            self._gate.slow_down(host, float(pause))
        return rules


def decoded(body: bytes, content_type: str) -> str:
    """The text of a body in the character set that its type names, else UTF-8; what is wrong in it is replaced."""
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type)
    try:
        return body.decode(named[1] if named else "utf-8-sig", "replace")
    except LookupError:
        return body.decode("utf-8-sig", "replace")


@contextmanager
def crawl_log(path: str) -> Iterator[logging.Logger]:
    """The package's log of a crawl in a file, written by a thread of its own so that no request waits for the disk."""
    log, lines = logging.getLogger("loomtext.crawl"), queue.SimpleQueue()
    file = logging.FileHandler(path, encoding="utf-8")
    file.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    entry, writer = QueueHandler(lines), QueueListener(lines, file)
    log.addHandler(entry)
    log.setLevel(logging.INFO)
    writer.start()
    try:
        yield log
    finally:
        log.removeHandler(entry)
        writer.stop()
        file.close()


async def crawl(
    seeds: Iterable[str], *, most_pages: int = 500, workers: int = 10, per_host: int = 2, delay: float = 0.2,
    domains: set[str] | None = None, get: Get = urllib_get, stats: CrawlStats | None = None,
) -> AsyncIterator[Page]:
    """Pages reachable from the seeds on their hosts (or ``domains``), each address once, HTML with status 200 only.

    Redirects re-enter the frontier as new addresses; the frontier holds at most twenty times ``most_pages``.
    """
    stats = stats if stats is not None else CrawlStats()
    first = [py_canonical_url(s) for s in seeds]
    hosts = domains or {urlsplit(s).hostname for s in first}
    gate, frontier, out = Gate(workers, per_host, delay), asyncio.Queue(), asyncio.Queue(maxsize=workers)
    robots, seen = Robots(get, gate), set()

    def admit(*links: str, base: str = "") -> None:
        """Queue the links that are web addresses on the hosts to crawl and new."""
        for link in links:
            if len(seen) >= 20 * most_pages:
                return
            with suppress(ValueError):
                address = py_canonical_url(link, base)
                if urlsplit(address).hostname in hosts and address not in seen:
                    seen.add(address)
                    frontier.put_nowait(address)

    async def visit(url: str) -> None:
        if not await robots.allowed(url):
            stats.blocked += 1
            log.info("%s is not allowed", url)
            return
        stats.requests += 1
        response = await fetch(url, get, gate)
        log.info("%s %d", url, response.status)
        if 300 <= response.status < 400 and "location" in response.headers:
            admit(response.headers["location"], base=url)
        elif response.status == 200 and "html" in (kind := response.headers.get("content-type", "").lower()):
            title, text, links = await asyncio.to_thread(lambda: py_parse_html(decoded(response.body, kind)))
            admit(*links, base=url)
            await out.put(Page(url, title, text, datetime.now(timezone.utc).isoformat()))

    async def work() -> None:
        while True:
            url = await frontier.get()
            try:
                await visit(url)
            except (OSError, ValueError, TimeoutError) as e:
                stats.failed += 1
                log.warning("%s failed: %s", url, e)
            finally:
                frontier.task_done()

    admit(*first)
    tasks = [asyncio.create_task(work()) for _ in range(workers)]
    idle = asyncio.create_task(frontier.join())
    try:
        while stats.pages < most_pages:
            page = asyncio.create_task(out.get())
            await asyncio.wait({page, idle}, return_when=asyncio.FIRST_COMPLETED)
            if not page.done() and out.empty():
                page.cancel()
                break
            yield await page
            stats.pages += 1
    finally:
        for task in (*tasks, idle):
            task.cancel()
        await asyncio.gather(*tasks, idle, return_exceptions=True)


async def collect(seeds: Iterable[str], target: str, **options) -> CrawlStats:
    """Crawl into a JSON Lines file, flushed after every page."""
    stats = options.setdefault("stats", CrawlStats())
    with open(target, "a", encoding="utf-8") as f:
        async for page in crawl(seeds, **options):
            await asyncio.to_thread(lambda p=page: (f.write(json.dumps(p.__dict__, ensure_ascii=False) + "\n"), f.flush()))
    return stats
