"""Repair of misread text: UTF-8 that was read in another encoding, once or more often, and characters in pieces."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What UTF-8 is misread as.
ENCODINGS = ("cp1252", "latin-1", "cp1250", "mac_roman")
#: Ranges of characters that repair may bring about: one alone only of the first, more in a row of all.
PLAIN = ((0xA0, 0x17F), (0x2010, 0x203A), (0x20AC, 0x20AC), (0x2122, 0x2122), (0x1F300, 0x1FAFF))
ALL = (*PLAIN, (0x370, 0x3FF), (0x400, 0x4FF), (0x2190, 0x21FF), (0x2600, 0x27BF), (0xFE0F, 0xFE0F))


@cache
def _bytes(encoding: str) -> dict[str, int]:
    """The byte of each character; bytes that the encoding has no character for are read as control characters."""
    return {bytes([b]).decode(encoding, "ignore") or chr(b): b for b in range(256)}


@cache
def _misread(encoding: str) -> re.Pattern:
    part = lambda low, high: "[" + re.escape("".join(c for c, b in _bytes(encoding).items() if low <= b <= high)) + "]"
    then = part(0x80, 0xBF)
    return re.compile(f"(?:{part(0xC2, 0xDF)}{then}|{part(0xE0, 0xEF)}{then}{{2}}|{part(0xF0, 0xF4)}{then}{{3}})+")


def _allowed(text: str) -> bool:
    ranges = PLAIN if len(text) == 1 else ALL
    return all(any(a <= ord(c) <= z for a, z in ranges) for c in text)


def _read(m: re.Match, encoding: str) -> str:
    try:
        text = bytes(_bytes(encoding)[c] for c in m[0]).decode("utf-8")
    except UnicodeDecodeError:
        return m[0]
    return text if _allowed(text) else m[0]


def repaired(text: str) -> str:
    """The shortest reading of a text by any of the encodings, again until none is shorter; then characters put together (NFC)."""
    while True:
        best = min((_misread(e).sub(lambda m, e=e: _read(m, e), text) for e in ENCODINGS), key=len)
        if len(best) >= len(text):
            return unicodedata.normalize("NFC", text)
        text = best


#: Any text with something to repair matches: UTF-8 as one of the encodings reads it, or a character that NFC changes or joins to others.
SUSPICIOUS = (
    # Most foreign characters stand alone, which is seen before the encodings are gone through.
    r"(?=[^\x00-\x7f]{2})(?:" + "|".join(_misread(e).pattern for e in ENCODINGS) + ")"
    r"|[\p{M}\u0340-\u0387\u0958-\u095f\u09dc-\u09df\u0a33-\u0a5e\u0b5c\u0b5d\u0f43-\u0f69\u1161-\u11ff\u1f71-\u1fff\u2000\u2001"
    r"\u2126-\u212b\u2329\u232a\u2adc\uf900-\ufb4f\x{1d15e}-\x{1d1c0}\x{2f800}-\x{2fa1f}]"
)


def plain(c: Column) -> Column:
    """Whether a text is ASCII alone: as many bytes as characters."""
    return F.octet_length(c) == F.length(c)


def foreign(c: Column) -> Column:
    """A text with a space for each run of ASCII."""
    return F.regexp_replace(c, r"[\x00-\x7f]+", " ")


def repair(c: Column) -> Column:
    """repaired(), of SUSPICIOUS texts; the others stay with Spark, only nulls are sent to Python in their place. ASCII is never suspicious and separates what may be."""
    some = F.when(plain(c), False).otherwise(foreign(c).rlike(SUSPICIOUS))
    return F.coalesce(_repaired(F.when(some, c)), c)


@F.pandas_udf(StringType())
def _repaired(s: pd.Series) -> pd.Series:
    return s.map(repaired, na_action="ignore")
