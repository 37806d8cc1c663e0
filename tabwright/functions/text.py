"""Category text normalisation, kept inside the JVM.

Spark has no compatibility fold (NFKD), so the folds are generated from the
Unicode database: code points that fold to one ASCII letter or digit, and
combining marks, go through ``translate``; the few that fold to several
characters are looked up only in rows that contain one of them.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"

# Normalised spellings of "no value".
EMPTY_WORDS = ["", "nan", "none", "null", "na"]

# Raw spellings turned into NULL before imputation (case-exact).
INVALID_WORDS = [
    "", "nan", "none", "null", "na", "n/a", "NaN", "None", "NULL", "NA", "N/A",
]

# Texts a CSV reader treats as missing.
CSV_NULL_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

#: ASCII characters that part words.
_MARKS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, str, dict[str, str]]:
    one_from, one_to, marks, several = [], [], [], {}
    for code in range(128, 0x20000):  # later planes fold to no ASCII and hold no marks
        ch = chr(code)
        if unicodedata.category(ch) == "Cs":
            continue
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        text = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if not any(c.isascii() and c.isalnum() for c in text):
            continue
        if len(text) == 1:
            one_from.append(ch)
            one_to.append(text)
        else:
            several[ch] = text
    return "".join(one_from), "".join(one_to), "".join(marks), several


def _ranges(chars, gap: int = 64) -> str:
    """A short character class body that covers ``chars`` and small gaps between them."""
    codes = sorted(map(ord, chars))
    parts, start, prev = [], codes[0], codes[0]
    for c in codes[1:] + [None]:
        if c is not None and c <= prev + gap:
            prev = c
            continue
        parts.append(f"\\x{{{start:x}}}" + (f"-\\x{{{prev:x}}}" if prev > start else ""))
        start = prev = c
    return "".join(parts)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once, however often it is used; branches of a ``when`` would each repeat it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fold_accents(text: Column) -> Column:
    """Drop accents and compatibility forms, as far as ASCII results go."""
    source, target, marks, several = _folds()
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")

    def wide(t: Column) -> Column:
        return F.array_join(
            F.transform(
                F.split(t, ""),
                lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.coalesce(F.try_element_at(table, c), c)),
            ),
            "",
        )

    return _once(text, lambda t: (
        F.when(~t.rlike("[^\\x00-\\x7f]"), t)
        .when(t.rlike(f"[{_ranges(several)}]"), F.translate(wide(t), source + marks, target))
        .otherwise(F.translate(t, source + marks, target))
    ))


def normalise_value(column: Column | str) -> Column:
    """Lower-case ASCII words separated by single spaces; no value -> 'unknown'."""
    c = F.col(column) if isinstance(column, str) else column
    other = "[^\\x00-\\x7f]"
    plain = _once(F.lower(c.cast("string")), lambda t: F.when(t.rlike(other), F.regexp_replace(fold_accents(t), f"{other}+", " ")).otherwise(t))
    # Looking at every character with a regular expression takes three times as long.
    spaced = F.translate(plain, _MARKS, " " * len(_MARKS))
    words = F.array_join(F.array_remove(F.split(spaced, " "), ""), " ")
    return _once(words, lambda w: F.when(w.isNull() | w.isin(EMPTY_WORDS), F.lit(UNKNOWN)).otherwise(w))


def invalid_to_null(column: Column | str) -> Column:
    c = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.when(c.isin(INVALID_WORDS), F.lit(None)).otherwise(c)
