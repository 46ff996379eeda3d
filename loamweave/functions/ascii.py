"""Any script to lower-case ASCII.

Latin letters lose their accents; letters of the Indic scripts are read off their Unicode names:
consonants without the inherent vowel, long vowels as short ones, nasal signs as m.  Other letters
that have a Latin name in Unicode keep its letters, everything else becomes a blank.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters with a rendering of their own.
SPECIAL = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."}
# Indic letters and signs, by the last word of their names.
INDIC = {"AA": "a", "II": "i", "UU": "u", "EE": "e", "OO": "o", "ANUSVARA": "m", "CANDRABINDU": "m", "VISARGA": "h", "VIRAMA": "", "NUKTA": "", "VOCALIC R": "r"}
DOUBLED = {"TT": "t", "TTH": "th", "DD": "d", "DDH": "dh", "DDDH": "rh", "NN": "n", "SS": "s", "SH": "s", "LL": "l", "LLL": "l", "RR": "r", "NNN": "n", "NG": "ng", "NY": "n"}


@lru_cache(maxsize=100_000)
def one(ch: str) -> str:
    low = ch.lower()
    if ch.isascii():
        return low
    if low in SPECIAL:
        return SPECIAL[low]
    plain = "".join(c for c in unicodedata.normalize("NFKD", low) if c.isascii())
    if plain:
        return plain
    if unicodedata.decimal(ch, None) is not None:
        return str(unicodedata.decimal(ch))
    name = unicodedata.name(ch, "")
    script, _, rest = name.partition(" ")
    kind, _, last = rest.rpartition("VOWEL SIGN ") if "VOWEL SIGN " in rest else rest.rpartition("LETTER ") if "LETTER " in rest else rest.rpartition("SIGN ")
    if not last or unicodedata.category(ch)[0] not in "LM":
        return "" if unicodedata.category(ch).startswith("M") else " "
    if last in INDIC:
        return INDIC[last]
    if script in INDIC_SCRIPTS and len(last) > 1 and last.endswith("A"):
        return DOUBLED.get(last[:-1], last[:-1].lower())
    return last.lower() if last.isalpha() and len(last) <= 4 else ""


INDIC_SCRIPTS = {"DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM"}


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else "".join(map(one, text)).lower()


def ascii_lower(c: Column) -> Column:
    """As an Arrow UDF; null is ''."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: lower_ascii(t) if t else "")

    return run(c)
