"""URLs and HTML: canonical form, origin, title, visible text and links.

Addresses are read by one expression of the JVM over whole columns; :func:`py_canonical_url` is the same definition for
single values, for the crawler. HTML is read by a scanner of tags, not by a parser of the whole grammar.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from email.utils import parsedate_to_datetime
from urllib.parse import quote_plus, unquote_plus, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default port of each scheme, and tags whose content isn't shown.
PORTS = {"http": 80, "https": 443}
HIDDEN = ("script", "style", "noscript")

# scheme, what stands before @, host, port, path, query; a bracketed host is an IPv6 address
_ADDRESS = r"^(?i:(https?))://(?:([^/?#]*)@)?(\[[0-9A-Fa-f:.]+\]|[^\s/?#@:\[\]\\]+)(?::([0-9]*))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"
_PY_ADDRESS = re.compile(_ADDRESS, re.DOTALL)


def py_canonical_url(url: str, base: str = "") -> str:
    """An absolute http(s) URL in one spelling; anything else is a ``ValueError``.

    Scheme and host are in lower case, the host in ASCII; a default port, credentials (an error), the fragment and the
    slashes at the end of the path go, though the root stays ``/``; query pairs are decoded, sorted and encoded again,
    pairs without a name and a value left out.
    """
    whole = urljoin(base, url.strip()) if base else url.strip()
    m = _PY_ADDRESS.match(whole)
    if not m or m[2] is not None:
        raise ValueError(f"not a web address: {url!r}")
    scheme, host = m[1].lower(), m[3] if m[3].isascii() else m[3].encode("idna").decode()
    port = int(m[4]) if m[4] else PORTS[scheme]
    if port > 65535:
        raise ValueError(f"no port: {port}")
    pairs = sorted(tuple(unquote_plus(x) for x in p.partition("=")[::2]) for p in (m[6] or "").split("&") if p)
    query = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in pairs)
    place = host.lower() + ("" if port == PORTS[scheme] else f":{port}")
    return f"{scheme}://{place}{(m[5] or '').rstrip('/') or '/'}" + (f"?{query}" if query else "")


def py_origin(url: str) -> str:
    """Scheme and place of a URL as written."""
    return re.match(r"[^:/?#]*://[^/?#]*", url)[0]


def canonical_url(url: Column | str) -> Column:
    """:func:`py_canonical_url` of a column, JVM-side; null where the value is null or no web address."""
    whole = F.regexp_replace(url if isinstance(url, Column) else F.col(url), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    part = lambda i: F.regexp_extract(whole, "(?sU)" + _ADDRESS, i)
    scheme, digits = F.lower(part(1)), part(4)
    host = F.when(part(3).rlike(r"^\p{ASCII}*$"), part(3)).otherwise(F.try_reflect(F.lit("com.ibm.icu.text.IDNA"), F.lit("convertIDNToASCII"), part(3), F.lit(0)))
    default = F.when(scheme == "http", PORTS["http"]).otherwise(PORTS["https"])
    port = F.when(digits == "", default).otherwise(F.coalesce(F.when(F.length(F.regexp_replace(digits, "^0+", "")) <= 5, digits.try_cast("int")), F.lit(-1)))
    place = F.concat(F.lower(host), F.when(port == default, F.lit("")).otherwise(F.concat(F.lit(":"), port.cast("string"))))
    path = F.coalesce(F.nullif(F.regexp_replace(part(5), r"/+$", ""), F.lit("")), F.lit("/"))
    name = lambda p: F.substring_index(p, "=", 1)
    pairs = F.transform(F.filter(F.split(part(6), "&"), lambda p: p != ""), lambda p: F.struct(_decoded(name(p)).alias("k"), _decoded(F.substr(p, F.length(name(p)) + 2)).alias("v")))
    query = F.array_join(F.transform(F.array_sort(pairs), lambda x: F.concat(_encoded(x["k"]), F.lit("="), _encoded(x["v"]))), "&")
    known = whole.rlike("(?sU)" + _ADDRESS) & ~whole.rlike(r"^[^:/]*://[^/?#]*@") & port.between(0, 65535)
    return F.when(known, F.concat(scheme, F.lit("://"), place, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _decoded(part: Column) -> Column:
    """Percent and plus signs of a query resolved; a percent sign without two hexadecimal digits stays."""
    return F.try_url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def origin(url: Column) -> Column:
    """``scheme://host[:port]`` as written; null where either is missing."""
    scheme, place = F.try_parse_url(url, F.lit("PROTOCOL")), F.try_parse_url(url, F.lit("AUTHORITY"))
    return F.concat(scheme, F.lit("://"), place)


# a quote that is not closed before the next tag belongs to the tag as it stands
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*|[^>]*)>",
    re.DOTALL,
)
_HREF = re.compile(r"""(?<![^\s"'/])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


def _pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name, content)`` in order: kind is ``text``, ``open`` or ``close``. What stands in a script or style is one text."""
    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        yield "close" if m[1] else "open", name, m[3]
        if name in HIDDEN[:2] and not m[1]:
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
    if at < len(page):
        yield "text", "", page[at:]


def py_parse_html(page: str) -> tuple[str, str, list[str]]:
    """Title, visible text (the title included) and links as written, white space collapsed.

    What stands in :data:`HIDDEN` tags is neither text nor link; a closing tag without an opening one changes nothing.
    """
    hidden, in_title = 0, False
    shown: dict[bool, list[str]] = {True: [], False: []}
    links: list[str] = []
    for kind, name, content in _pieces(page):
        if name in HIDDEN:
            hidden = hidden + 1 if kind == "open" else max(hidden - 1, 0)
        elif hidden:
            continue
        elif kind == "text":
            text = html.unescape(content)
            shown[False].append(text)
            if in_title:
                shown[True].append(text)
        elif name == "title":
            in_title = kind == "open"
        elif (name, kind) == ("a", "open") and (m := _HREF.search(content)):
            links += [html.unescape(v) for v in m.groups() if v]
    return " ".join("".join(shown[True]).split()), " ".join(" ".join(shown[False]).split()), links


def parse_html(page: Column | str) -> Column:
    """:func:`py_parse_html` of a column, as a struct; a null page has empty parts."""

    @F.pandas_udf("title string, text string, links array<string>")
    def parsed(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([py_parse_html(p or "") for p in pages], columns=["title", "text", "links"])

    return parsed(page)


def retry_after(value: str | None, now: float) -> float:
    """Seconds to wait that a Retry-After header asks for: whole seconds or a date, never below 0; 0 if neither."""
    asked = (value or "").strip()
    if asked.isascii() and asked.isdigit():
        return float(asked)
    try:
        return max(0.0, parsedate_to_datetime(asked).timestamp() - now)
    except (TypeError, ValueError):
        return 0.0
