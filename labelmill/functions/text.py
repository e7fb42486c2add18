"""Text normalisation and pre-tokenisation as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Runs of word characters, and runs of anything that is neither word nor white space.
# The classes are spelled out because \w and \s cover ASCII only.
_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
_SPACE = r"\t\n\x0B\f\r\x{85}\p{Z}"
TOKEN_PATTERN = rf"[{_WORD}]+|[^{_WORD}{_SPACE}]+"


@cache
def accent_table() -> tuple[str, str]:
    """``translate`` arguments that decompose each character and drop its non-spacing marks.

    Built from the Unicode database. ``translate`` replaces one character by at most one, so
    characters that decompose into several base characters (Hangul syllables) stay as they are.
    """
    source, target, dropped = [], [], []
    for code in range(0x80, 0x110000):
        character = chr(code)
        if unicodedata.category(character) in ("Cs", "Cn", "Co"):
            continue
        base = [c for c in unicodedata.normalize("NFD", character) if unicodedata.category(c) != "Mn"]
        if not base:
            dropped.append(character)
        elif len(base) == 1 and base[0] != character:
            source.append(character)
            target.append(base[0])
    return "".join(source + dropped), "".join(target)


def normalise(text: Column) -> Column:
    """Lower-case, decompose, strip accents. Pure ASCII rows skip the character table."""
    source, target = accent_table()
    lowered = F.lower(text)
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, lowered).otherwise(F.translate(lowered, source, target))


def tokens(text: Column) -> Column:
    """Array of word and punctuation runs."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def words_of(name: str) -> Column:
    """Tokens of the normalised text column ``name``."""
    return tokens(normalise(F.col(name)))
