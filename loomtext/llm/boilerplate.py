"""Main body of web pages by composite text density, over the visible text of a page, one block a line.

The tables hold no tags, so the tree is rebuilt: a page's children are runs of lines, and their children are the lines,
each with one tag. What tags would tell, how much of a line stands in links or in the site's template, is a share from 0
to 1 that comes from counts over the collection, not from lists of words:

- how many pages of its site have the line, digits and the site's name masked; on small sites, how many pages of all
  sites that have it;
- for a menu the same of each of its items, so that an item is known wherever it stood;
- for lines held together by marks, such as trails and links to neighbouring pages, the same of their first mark;
- for a line that on nearly all its pages is followed by a title that differs from page to page, that rate: it is the
  label of a list of links, and the titles that follow it share it.

Then text densities decide: a line is main body if it is no more linked than the threshold that the path from the
subtree with the greatest sum of densities to the whole page gives.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate, chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.scratch import written
from loomtext.skew import join_per_key

#: Shares of pages from which a line, and a line's first mark, are as likely linked as not; a share counts in proportion.
SHARE, MARK_SHARE = 0.2, 0.0625
#: A line's linked share is taken to be at least FLOOR, and at most TOP where pages repeat it; a label's is at least LABEL.
FLOOR, TOP, LABEL = 0.1, 0.98, 0.9

#: Longer lines are neither menus nor links to neighbouring pages.
LONG = 300

_SEPARATOR = re.compile(r"\s+[|·•/»>›]\s+|\s{2,}")
_END = re.compile(r"[.!?。！？।؟…:;,]['\"”’»」』)）\]]*$")
_CODE = re.compile(r"^(?:>>>|\$ |\.\.\.|#!|import |from \S+ import|return\b|def |class |with |\[)|[=(){};]|--\w")
_BULLET = re.compile(r"^(?:[-*•–]|\d+[.)])\s")
_DIGITS = re.compile(r"\d+")
_LISTED, _OWN, _TRAIL = 1, 2, 4


def heading_of(title: str | None, site: str) -> str:
    """The title without the site's name after its last separator, in lower case."""
    title = (title or "").strip()
    head, _, tail = re.sub(r" [|—–-] (?=[^|—–-]*$)", "\0", title).partition("\0")
    return (head if tail and tail.strip().casefold() == site else title).strip().casefold()


def may_be_listed(line: str) -> bool:
    """Whether the line can be the title of another page in a list."""
    return len(line) <= 60 and len(line.split()) <= 8 and not _END.search(line[-8:]) and not _CODE.search(line) and not _BULLET.match(line)


def first_mark(line: str) -> str | None:
    """What holds a line of several marks together: its first word if that is a mark, or the sign that recurs in it and what
    stands before it. None for sentences, code, list items and lines with fewer than two marks."""
    if _END.search(line[-8:]):
        return None
    words = line.split()
    is_mark = [not w.isalnum() and (len(w) > 1 and (w[0] == "#" or w[-1] == ":") or not any(map(str.isalnum, w))) for w in words]
    if sum(is_mark) < 2 or _CODE.search(line) or _BULLET.match(line):
        return None
    if is_mark[0]:
        return "#" if words[0][0] == "#" else words[0].lower()
    sign, times = Counter([w for w, m in zip(words, is_mark) if m and len(w) == 1] or [""]).most_common(1)[0]
    return f"{line.split(f' {sign} ')[0].lower()} {sign}" if times > 1 else None


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Reader:
    """Features of lines; what doesn't depend on the page is kept for the lines that a site repeats."""

    def __init__(self, most: int = 100_000):
        self.most, self.seen = most, {}

    def _key(self, kind: str, part: str, name: str) -> int:
        low = part.lower().replace(name, "@") if name else part.lower()
        masked = _DIGITS.sub("0", low)
        return _hash(kind + masked) if kind == "mark " or any(c.isalpha() or c == "@" for c in masked) else 0

    def _line(self, line: str, name: str) -> tuple:
        mark = first_mark(line) if len(line) <= LONG else None
        parts = [p for p in _SEPARATOR.split(line) if p] if len(line) <= LONG else []
        items = [(k, len(p)) for p in parts if (k := self._key("line ", p, name))] if len(parts) >= 3 and max(map(len, parts)) <= 24 else []
        listed = _LISTED * may_be_listed(line)
        return line.casefold(), listed, self._key("line ", line, name), self._key("mark ", mark, name) if mark else 0, [k for k, _ in items], [n for _, n in items]

    def page(self, text: str, title: str | None, name: str) -> list[tuple]:
        """Of every line that isn't blank: its number, characters, flags, and the keys by which pages are compared: the line's,
        its first mark's, those of its menu items, with the characters of each. The flags tell lines that can be titles in
        a list, the page's own heading, and trails that end in it. A line without letters has the key 0, as has what has
        no mark."""
        heading, out = heading_of(title, name), []
        for number, raw in enumerate(text.split("\n")):
            line = raw.strip()
            if not line:
                continue
            known = self.seen.get((line, name))
            if known is None:
                known = self._line(line, name)
                if len(line) <= 100 and len(self.seen) < self.most:
                    self.seen[line, name] = known
            low, flags, key, mark, items, sizes = known
            if heading and low.endswith(heading):
                flags += _OWN if low == heading else _TRAIL * any(low.endswith(f" {s} {heading}") for s in "/>»›")
            out.append((number, len(line), flags, key, mark, items, sizes))
        return out


def composite_density(chars: float, tags: float, link_chars: float, link_tags: float, body_share: float) -> float:
    """Composite text density: characters per tag, adjusted by the characters and tags in links, which are above 0 and below
    all; ``body_share`` is the part of the whole page's characters that stands in links."""
    base = math.log(chars / (chars - link_chars) * link_chars + body_share * chars + math.e)
    return chars / tags * math.log(chars / link_chars * tags / link_tags) / math.log(base)


def linked_shares(lines: Iterable[tuple], known: dict[int, tuple[float, float]]) -> list[float]:
    """Of each line of :meth:`_Reader.page` the share that stands in links, from the linked share and the label rate that its
    site's pages give its keys."""
    none = (0.0, 0.0)
    out, listing = [], 0.0
    for _, chars, flags, key, mark, items, sizes in lines:
        if flags & _OWN:
            share, listing = 0.0, 0.0
        elif flags & _TRAIL:
            share, listing = TOP, 0.0
        else:
            share, label = known.get(key, none)
            if mark:
                share = max(share, known.get(mark, none)[0])
            if items:
                share = max(share, sum(n * known.get(k, none)[0] for k, n in zip(items, sizes)) / sum(sizes))
            if label and flags & _LISTED:
                share, listing = max(share, label), label
            elif share >= 0.5 or not flags & _LISTED:
                listing = 0.0
            share = max(share, listing)
        out.append(min(max(share, FLOOR), TOP))
    return out


def main_lines(chars: list[int], shares: list[float]) -> list[int]:
    """Places of the lines of the main body.

    Neighbouring lines that are more, or less, than half linked are one subtree, and the page is the tree of all. Of the
    subtrees the one whose lines' densities add up to most is the core; a page whose core is mostly linked has no main
    body. The threshold is the lowest density on the path from the core to the page, a character of it, as characters per
    tag would tell a long line from a short one and not text from links; every line that reaches it is main body.
    """
    if not chars:
        return []
    body = sum(c * s for c, s in zip(chars, shares)) / sum(chars)

    def per_character(places: Sequence[int]) -> float:
        c, lc = sum(chars[i] for i in places), sum(chars[i] * shares[i] for i in places)
        return composite_density(c, len(places), lc, sum(shares[i] for i in places), body) * len(places) / c

    of_line = [composite_density(c, 1, c * s, s, body) for c, s in zip(chars, shares)]
    runs: list[list[int]] = []
    for i, share in enumerate(shares):
        if not i or (shares[i - 1] < 0.5) != (share < 0.5):
            runs.append([])
        runs[-1].append(i)
    core = max(runs, key=lambda run: sum(of_line[i] for i in run))
    if shares[core[0]] >= 0.5:
        return []
    threshold = min(per_character(core), per_character(range(len(chars))))
    return [i for i, c in enumerate(chars) if of_line[i] / c >= threshold]


def _site(url: Column) -> Column:
    host = F.regexp_extract(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return F.regexp_replace(host, r"^www\.|\.$", "")


def _name(site: Column) -> Column:
    """What a site calls itself: the label before its top-level domain."""
    return F.coalesce(F.nullif(F.regexp_extract(site, r"([^.]+)\.[^.]+$", 1), F.lit("")), site)


_FEATURES = "no array<int>, chars array<int>, flags array<int>, keys array<long>, marks array<long>, items array<long>, item_chars array<int>, item_counts array<int>"


def _lists(column: pa.ListArray) -> list[list]:
    """The lists of an Arrow column as Python lists, by one conversion of all values."""
    values, at = column.flatten().to_numpy(zero_copy_only=False).tolist(), column.offsets.to_numpy()
    at = (at - at[0]).tolist()
    return [values[a:b] for a, b in zip(at, at[1:])]


def _keyed(pages: DataFrame) -> DataFrame:
    """Of every page its site, the hash of its address without query and fragment, and its lines' features; texts stay behind."""
    address = F.regexp_replace(F.lower(F.trim("url")), r"^[a-z][a-z0-9+.-]*://|[?#].*$|/+(?=$|[?#])", "")
    site = _site(F.col("url"))
    rows = pages.where("page_id is not null and text is not null").select("page_id", site.alias("site"), _name(site).alias("name"), F.xxhash64(address).alias("at"), "title", "text")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader()
        for pdf in batches:
            rows = []
            for text, title, name in zip(pdf.text, pdf.title, pdf.name):
                *flat, items, sizes = list(zip(*reader.page(text, title, name))) or [()] * 7
                rows.append((_hash(text), *flat, list(chain.from_iterable(items)), list(chain.from_iterable(sizes)), list(map(len, items))))
            names = ["same", *(c.split()[0] for c in _FEATURES.split(", "))]
            yield pd.concat([pdf[["page_id", "site", "at"]], pd.DataFrame(rows, columns=names)], axis=1)

    return rows.mapInPandas(read, f"page_id long, site string, at long, same long, {_FEATURES}")


def evidence(keyed: DataFrame, share: float = SHARE, least_pages: int = 8) -> DataFrame:
    """``(site, n, known, labels)``: of each site its pages and, for the keys that its pages show, the linked share that
    repetition gives and the rate at which titles follow.

    Pages with the same text on a site, or of the same address but for query and fragment, count once. Of a site with
    at least ``least_pages`` a key's pages are compared with the site's, if they are at least three, else with those of
    all sites that have the key, if those are at least three; marks are always compared with both. What is gathered per site are keys of more than a small
    share of pages, of which a site has at most its lines per page over that share.
    """
    once = keyed.groupBy("site", "same").agg(F.min(F.struct("at", "page_id")).alias("p")).groupBy("site", "p.at").agg(F.min("p.page_id").alias("page_id"))
    once = written(once.select("site", "page_id"), "page-once")
    seen = keyed.join(once.select("page_id"), "page_id", "left_semi")
    sites = written(once.groupBy("site").agg(F.count("*").alias("n")), "page-sites")
    entry = lambda c, mark: F.transform(c, lambda k: F.struct(k.alias("key"), F.lit(mark).alias("mark")))
    every = F.array_distinct(F.concat(entry("keys", False), entry("marks", True), entry("items", False)))
    shown = seen.select("site", F.explode(every).alias("k")).select("site", "k.key", "k.mark").where("key <> 0")
    times = shown.groupBy("site", "key", "mark").agg(F.count("*").alias("times"))
    times = written(join_per_key(times, sites, ["site"], "n"), "page-keys")
    pooled = times.groupBy("key").agg(F.count("*").alias("sites"), (F.sum("times") / F.sum("n")).alias("part"))
    pooled = pooled.where((F.col("sites") >= 3) & (F.col("part") >= 0.02)).select("key", "part")

    is_listed = lambda i: F.get("flags", i).bitwiseAND(_LISTED | _OWN) == _LISTED
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("no") - 1, F.lit(0))), lambda i: F.coalesce(is_listed(i) & (F.get("keys", i) != 0), F.lit(False)))
    pairs = F.transform(at, lambda i: F.struct(F.get("keys", i).alias("key"), F.when(is_listed(i + 1), F.get("keys", i + 1)).alias("then")))
    followed = seen.select("site", F.explode(pairs).alias("p")).groupBy("site", "p.key", "p.then").agg(F.count("*").alias("c"))
    # a pair that a site repeats is its template, not a label with a title
    titles = F.sum(F.when(F.col("then").isNotNull() & (F.col("c") < 3), F.col("c")).otherwise(0))
    labels = followed.groupBy("key").agg(((titles + 1) / (F.sum("c") + 2)).alias("label")).where(F.col("label") >= LABEL)

    own = F.when(F.col("mark") | (F.col("n") >= least_pages), F.when(F.col("times") >= 3, F.col("times") / F.col("n")).otherwise(0.0)).otherwise(0.0)
    others = F.when(F.col("mark") | (F.col("n") < least_pages), F.coalesce("part", F.lit(0.0))).otherwise(0.0)
    linked = F.least(F.greatest(own, others) / (2 * F.when(F.col("mark"), F.lit(share * MARK_SHARE / SHARE)).otherwise(F.lit(share))), F.lit(TOP))
    known = times.join(pooled, "key", "left").join(labels, "key", "left").select("site", "key", linked.alias("linked"), "label")
    known = known.where((F.col("linked") > FLOOR) | F.col("label").isNotNull())
    per_site = known.groupBy("site").agg(F.collect_list(F.struct("key", "linked", F.coalesce("label", F.lit(0.0)).alias("label"))).alias("known"))
    none = F.array().cast("array<struct<key: bigint, linked: double, label: double>>")
    return sites.join(per_site, "site", "left").select("site", "n", F.coalesce("known", none).alias("known"))


def main_body(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """``(page_id, line_no)``: of every page the lines of its main body, counted from 0, blank ones left out.

    ``pages`` has ``page_id``, ``url``, ``title`` and ``text``; other columns are ignored. Null and blank texts and pages
    without main body give no rows; a null title or URL only takes their evidence away; pages of one id are told apart
    by nothing and each give their rows. Of an empty table nothing comes out. Texts are read once, whole; what is
    shuffled are hashes of lines.
    """
    keyed = written(_keyed(pages), "page-lines")
    per_site = written(evidence(keyed, share), "page-evidence")
    names = [c.split()[0] for c in _FEATURES.split(", ")]
    ready = join_per_key(keyed.select("page_id", "site", *names), per_site, ["site"], "n")
    ready = ready.select("page_id", "site", *names, F.col("known.key").alias("key"), F.col("known.linked").alias("linked"), F.col("known.label").alias("label"))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sites: dict[str, dict[int, tuple[float, float]]] = {}
        for batch in batches:
            ids, numbers = [], []
            keys, linked, labels = (batch.column(c) for c in ("key", "linked", "label"))
            flat = [_lists(batch.column(c)) for c in names]
            for i, (page, site) in enumerate(zip(batch.column("page_id").to_pylist(), batch.column("site").to_pylist())):
                known = sites.get(site)
                if known is None:
                    if len(sites) >= 1000:
                        sites.clear()
                    known = sites[site] = dict(zip(keys[i].as_py(), zip(linked[i].as_py(), labels[i].as_py())))
                no, chars, flags, line_keys, marks, items, sizes, counts = (c[i] for c in flat)
                at = list(accumulate(counts, initial=0))
                lines = ((0, 0, f, k, m, items[a:b], sizes[a:b]) for f, k, m, a, b in zip(flags, line_keys, marks, at, at[1:]))
                kept = main_lines(chars, linked_shares(lines, known))
                ids += [page] * len(kept)
                numbers += [no[j] for j in kept]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], names=["page_id", "line_no"])

    return ready.mapInArrow(bodies, "page_id long, line_no int")


def body_text(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """``(page_id, text)``: the text of every page with a main body, its lines without white space around them."""
    kept = main_body(pages, share).groupBy("page_id").agg(F.sort_array(F.collect_set("line_no")).alias("_kept"))
    lines = F.split("text", "\n")
    both = pages.where("text is not null").select("page_id", "text").join(kept, "page_id")
    return both.select("page_id", F.array_join(F.transform("_kept", lambda i: F.regexp_replace(F.get(lines, i), r"(?U)^\s+|\s+$", "")), "\n").alias("text"))
