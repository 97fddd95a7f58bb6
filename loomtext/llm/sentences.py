"""Sentence units of documents in any script, by a pushdown automaton over marks, quotes and brackets.

The automaton reads a paragraph's events only: sentence marks, opening and closing marks, list marks, Thai spaces. Its
stack holds the open quotes and brackets and the levels of lists: an item drops what was opened in the items before it at
its level or deeper and not closed, and the mark of an item ends nothing. A sentence mark inside quotes or brackets ends
nothing either, and when they close after one, what was open and what follows decide. Abbreviations are looked up
backwards from a full stop in tries. Every step takes time in proportion to what it reads, so a text takes linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Titles before a name, as they are written (in lower case, ``ms`` and others are units or words).
TITLES = ("Dr", "dr", "Prof", "prof", "Mr", "Mrs", "Ms", "St", "Gen", "Rev", "Hon", "Hr", "Fr", "Dipl", "Ing", "Mme", "Mlle", "MM", "Sr", "Sra", "Srta", "Dra", "Ud", "Uds")
#: Abbreviations (without the last full stop) that stand before what they belong to.
BEFORE = (
    "cf", "e.g", "eg", "i.e", "viz", "vs", "approx", "esp", "bzw", "ca", "z.b", "z. b", "d.h", "d. h", "vgl", "sog", "ggf", "inkl",
    "evtl", "geb", "np", "m.in", "tzn", "tj", "bijv", "o.a", "d.w.z", "p.es", "p. es", "p. ex", "p.ex", "ex", "p. ej", "p.ej", "ej", "aprox",
    "проф", "акад", "див", "тис", "млн", "млрд", "ім", "вул", "напр", "просп", "смт", "м", "डॉ", "श्री", "कृ", "د", "أ",
)
#: Abbreviations that stand before a number.
BEFORE_NUMBER = (
    "no", "nos", "fig", "figs", "sec", "ch", "chap", "vol", "p", "pp", "art", "eq", "ver", "jan", "feb", "mar", "apr", "jun", "jul",
    "aug", "sep", "sept", "oct", "nov", "dec", "nr", "abb", "abs", "kap", "rys", "tabl", "poz", "ust", "sez", "pag", "hfst", "tab", "bd", "s", "pág", "págs", "núm", "cap", "рис", "табл",
    "гл", "розд", "с", "п", "ст", "т", "ص",
)
#: Abbreviations after which a sentence can end.
AFTER = (
    "etc", "al", "inc", "ltd", "co", "corp", "jr", "u.s", "u.k", "a.m", "p.m", "ff", "usw", "u.a", "itd", "itp", "ecc", "enz", "min", "std", "env", "bros", "dept",
    "ін", "т.д", "т. д", "т.п", "т. п", "н.е", "н. е", "р", "рр", "грн", "год", "хв", "д", "е", "h",
)
#: Names of months after a number with a full stop.
MONTHS = ("Januar", "Jänner", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")

#: What is longer without white space is no word.
LONGEST = 500

_PAIRS = {"(": ")", "（": "）", "[": "]", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "«": "»", "‘": "’"}
_CLOSES = {v: k for k, v in _PAIRS.items()}
_BRACKETS = set("(（[［【")
_TRAILING = "\"”’»)）]］】」』》“*_`"
_THAI = "ก-ฺเ-๎"
_EVENT = re.compile(rf"[.!?…。！？।॥؟۔]+|[\"“”„«»‘’「」『』《》()（）\[\]［］【】]|(?<=[{_THAI}])[  ]+(?=[{_THAI}])")
_ITEM = re.compile(r"\n[^\S\n]*(?:[-*•–]|\d+[.)])[^\S\n]+(?=\S)")
_PARAGRAPH = re.compile(r"\S(?:.|\n(?![^\S\n]*\n))*")
_FULL = set("。！？।॥؟۔")
_OPENERS = re.compile(r"(?:[*_`~]+(?=\S)|[\"“„«‘「『《(（\[¿¡]\s*)*")
_MARK = re.compile(r"(?:>\s*|[-*•–]\s+|\d+[.)]\s+)*")
_INITIAL = re.compile(r"\w\.")
_DOTTED = re.compile(r"[^\W\d_]\w+(?:\.\w{2,})+")
_WORD = re.compile(r"[\w'’-]+")


def _trie(words: tuple[str, ...]) -> dict:
    """Nested dictionaries over the words read backwards; the key ``""`` ends one."""
    root: dict = {}
    for word in words:
        node = root
        for c in reversed(word):
            node = node.setdefault(c, {})
        node[""] = True
    return root


_TITLES, _TRIES = _trie(TITLES), tuple(_trie(w) for w in (BEFORE, BEFORE_NUMBER, AFTER))


def _abbreviation(text: str, start: int, stop: int, trie: dict, cased: bool = False) -> bool:
    """Whether a word of the trie, as a whole word, ends at ``stop`` and begins at or after ``start``."""
    node, i = trie, stop - 1
    while i >= start:
        node = node.get(text[i] if cased else text[i].lower())
        if node is None:
            return False
        if "" in node and (i == start or not (text[i - 1].isalnum() or text[i - 1] in ".’'_")):
            return True
        i -= 1
    return False


def _events(text: str, start: int, stop: int) -> list[tuple[int, int, bool]]:
    """``(start, end, item)`` of every event of a paragraph in order; the mark of a list item is one, whatever it consists of."""
    events = [(*m.span(), False) for m in _EVENT.finditer(text, start, stop)]
    items = [(m.start() + 1, m.end(), True) for m in _ITEM.finditer(text, start, stop)] if text.find("\n", start, stop) >= 0 else []
    if not items:
        return events
    inside = {i for a, b, _ in items for i in range(a, b)}
    return sorted([*items, *(e for e in events if e[0] not in inside)])


def _pairs(events: list[tuple[int, int, bool]], text: str) -> dict[int, int]:
    """Start of each opening mark to that of its closing mark and back; marks without partner are in neither."""
    stack: list[tuple[str, int]] = []  # a mark and its place, or "item" and the width before its mark
    places: dict[str, list[int]] = {}  # of each mark those of its places on the stack
    found: dict[int, int] = {}

    def push(mark: str, at: int) -> None:
        places.setdefault(mark, []).append(len(stack))
        stack.append((mark, at))

    def drop(size: int) -> None:
        while len(stack) > size:
            places[stack.pop()[0]].pop()

    def close(opening: str, at: int) -> bool:
        size = max((places[o][-1] for o in opening if places.get(o)), default=-1)
        if size >= 0:
            found[stack[size][1]], found[at] = at, stack[size][1]
            drop(size)
        return size >= 0

    for a, b, item in events:
        c = text[a]
        if item:
            level = len(text[a:b]) - len(text[a:b].lstrip())
            while places.get("item") and stack[places["item"][-1]][1] >= level:
                drop(places["item"][-1])
            push("item", level)
        elif b - a > 1 or c in ".!?…" or c in _FULL or c.isspace():
            continue
        elif c == '"':
            close('"', a) or push(c, a)
        elif c == "“":
            close("„", a) or push(c, a)
        elif c == "”":
            close("“„", a)
        elif c == "’":
            if not text[b : b + 1].isalnum():
                close("‘", a)
        elif c in _PAIRS or c == "„":
            push(c, a)
        else:
            close(_CLOSES[c], a)
    return found


def _kind(text: str, end: int, at: int, stop: int) -> str:
    """What the text at ``at`` begins with: u(pper), l(ower), c(aseless letter), d(igit), -, other punctuation or nothing.

    A dotted name in lower case can begin a sentence and counts as upper. Opening marks are skipped, and list and quote marks where a line begins between ``end`` and ``at``.
    """
    i = _MARK.match(text, at, stop).end() if "\n" in text[end:at] else at
    i = _OPENERS.match(text, i, stop).end()
    if i >= stop:
        return ""
    c = text[i]
    if c.isdigit():
        return "d"
    if c.isalpha():
        return ("u" if _DOTTED.match(text, i, stop) else "l") if c.islower() else "u" if c.isupper() or c.istitle() else "c"
    return "-" if c in "—–-" else "c" if c.isalnum() else "p"


def _stops(text: str, start: int, a: int, b: int, stop: int) -> bool:
    """Whether the run of marks ``text[a:b]`` at the top level, with what trails it up to ``b``, ends the unit."""
    marks = text[a:b].rstrip(_TRAILING)
    if marks[-1] in _FULL:
        return True
    after = b
    while after < stop and text[after].isspace():
        after += 1
    if after >= stop:
        return True
    kind, near = _kind(text, b, after, stop), after == b
    if marks[-1] in "!?":
        return kind in "uc" and text[b] not in "=&/" if near else kind != "p" and not (kind == "-" and text[after] in "—–")
    if len(marks) > 1 or marks == "…":
        return (not near or marks == "…") and kind in "ucd" and text[a - 1 : a] != "/"
    if near and kind not in "u":
        return False
    first = a
    while first > start and not text[first - 1].isspace() and text[first - 1] not in "\"“„«‘(（[「":
        first -= 1
        if a - first > LONGEST:
            return not near and kind != "p"
    word = text[first:a]
    if near and (len(word) < 2 or not word[-1].isalpha() or not word[-1].islower() or any(c in word for c in "/=@\\") or "." in word and not word[0].islower()):
        return False
    if kind == "p":
        return False
    if word.isdigit() or (len(word) > 1 and word[-1].isdigit() and word[:-1].replace(".", "").isdigit()):
        if kind == "l":
            return False
        if not _MARK.fullmatch(text, start, after) is None or word.isdigit() and (m := _WORD.match(text, after)) and m.group() in MONTHS:
            return False
        return True
    before, number, may = (_abbreviation(text, start, a, t) for t in _TRIES)
    before = before or _abbreviation(text, start, a, _TITLES, cased=True)
    if may and kind != "l":
        return kind in "ud" and not (before and len(word) > 1)
    if before or may:
        return False
    if number and kind == "d":
        return False
    if len(word) == 1 and word.isalpha() and (word.isupper() or word.islower() and (kind in "ld" or _INITIAL.match(text, after))):
        return False
    return kind != "-" or text[after] == "-"


def units(text: str) -> list[tuple[int, int]]:
    """``(start, end)`` of every sentence unit, in characters, without white space around it."""
    out: list[tuple[int, int]] = []
    for p in _PARAGRAPH.finditer(text):
        start, stop = p.start(), p.end()
        while stop > start and text[stop - 1].isspace():
            stop -= 1
        events = _events(text, start, stop)
        pairs = _pairs(events, text)
        depth, past = 0, start
        for a, b, item in events:
            if a < past or item:
                continue
            ends = False
            partner = pairs.get(a)
            if partner is not None and partner > a:
                depth += 1
            elif partner is not None:
                depth -= 1
                if depth == 0:
                    ends = _closes(text, start, partner, a, stop)
            elif depth == 0:
                if text[a].isspace():
                    ends, b = True, a
                elif text[a] in ".!?…" or text[a] in _FULL:
                    while b < stop and text[b] in _TRAILING and b not in pairs:
                        b += 1
                    ends = _stops(text, start, a, b, stop)
            if ends:
                out.append((start, b))
                start = past = b
                while start < stop and text[start].isspace():
                    start += 1
        if start < stop:
            out.append((start, stop))
    return out


def _closes(text: str, start: int, opened: int, closing: int, stop: int) -> bool:
    """Whether the unit ends with the quote or bracket at ``closing``, which leaves nothing open."""
    last = closing - 1
    while last > opened and text[last].isspace():
        last -= 1
    if text[last] not in ".!?…" and text[last] not in _FULL:
        return False
    after = closing + 1
    while after < stop and text[after].isspace():
        after += 1
    if after >= stop:
        return True
    whole, kind, near = _MARK.match(text, start, stop).end() >= opened, _kind(text, closing, after, stop), after == closing + 1
    if text[opened] in _BRACKETS:
        return whole and kind in "ucd"
    if kind == "c":
        return whole and not near
    return kind in ("u" if near else "ud")


def sentences(documents: DataFrame) -> DataFrame:
    """``(doc_id, sent_start, sent_end)``: the sentence units of every ``text``, in characters from 0.

    Null and blank texts give none; texts of any length are read whole; documents with one id each give theirs; columns
    beside ``doc_id`` and ``text`` are ignored; an empty table gives no rows. A quote or bracket without partner in its
    paragraph is an ordinary character. Every document is read by one pass in its task, and nothing is shuffled.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, starts, ends = [], [], []
            for doc, text in zip(pdf.doc_id, pdf.text):
                for a, b in units(text):
                    ids.append(doc)
                    starts.append(a)
                    ends.append(b)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "sent_start": pd.Series(starts, dtype="int64"), "sent_end": pd.Series(ends, dtype="int64")})

    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return rows.mapInPandas(cut, "doc_id long, sent_start long, sent_end long")
