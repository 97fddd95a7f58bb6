"""Normal form, tokens and word chunks as JVM-side expressions.

Spark has no Unicode normalisation or case folding of its own, but it ships ICU; ``reflect`` reaches ICU's static
methods, so the exact normal form needs no Python worker.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is letters and digits with inner apostrophes; these characters count as an apostrophe.
TOKEN = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"
APOSTROPHES = "’ʼ‘"

_PY_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_PY_APOSTROPHES = dict.fromkeys(map(ord, APOSTROPHES), "'")


def _nfc(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))


def normal_form(text: Column) -> Column:
    """NFC, full case folding, NFC again, apostrophes made ``'``; null stays null."""
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _nfc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.when(text.isNotNull(), F.translate(_nfc(folded), APOSTROPHES, "'" * len(APOSTROPHES)))


def tokens(text: Column) -> Column:
    """The tokens of a text in order; null and blank texts have none."""
    return F.coalesce(F.regexp_extract_all(normal_form(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def py_normal_form(text: str) -> str:
    """:func:`normal_form` of one string, for driver-side query text and Python workers."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold()).translate(_PY_APOSTROPHES)


def py_tokens(text: str) -> list[str]:
    """:func:`tokens` of one string."""
    return _PY_TOKEN.findall(py_normal_form(text))


def words(text: Column) -> Column:
    """Text split at Unicode white space, without empty pieces."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def word_chunks(text: Column, size: int = 160, overlap: int = 32) -> Column:
    """Overlapping runs of ``size`` words, each starting ``size - overlap`` after the last, until one reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    w, step = words(text), size - overlap
    last = F.when(F.size(w) > size, F.ceil((F.size(w) - size) / F.lit(step))).otherwise(0).cast("int")
    starts = F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, size), " "))


def title_or_stem(title: Column, path: Column) -> Column:
    """The title, or where it is null or empty the file name without suffix, ``_`` made a space."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.when(title != "", title), F.translate(stem, "_", " "), F.lit(""))
