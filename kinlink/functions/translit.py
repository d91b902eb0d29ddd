"""Romanisation of other scripts, from the names of their letters in the Unicode database.

Consonants of Indic scripts are written without their inherent vowel, vowel signs by their name, the
nasal signs as N; the caller lowers and adapts the result.  Only rows with such characters need it.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinlink.functions.text import NON_LATIN, fold_latin, is_non_latin, latin_table

_NON_LATIN = re.compile(NON_LATIN)
_TAMIL = re.compile("[஀-௿]")
# Malayalam final consonants and the double rra, spelt out.
MALAYALAM = {"ൽ": "ല്", "ൻ": "ന്", "ർ": "ര്", "ൺ": "ണ്", "ൾ": "ള്", "ൿ": "ക്", "റ്റ": "ട്ട"}


@cache
def romanised(c: str) -> str:
    """ASCII spelling of one character."""
    if ord(c) < 128:
        return c
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    name = unicodedata.name(c, "")
    if m := re.search(r"VOWEL SIGN (?:SHORT |CANDRA |VOCALIC )?([A-Z]+)$", name):
        return m[1].lower()
    if re.search(r"SIGN (CANDRABINDU|ANUSVARA|BINDI|TIPPI)$", name):
        return "N"
    if name.endswith("SIGN VISARGA"):
        return "H"
    if re.search(r"SIGN (VIRAMA|NUKTA)|JOINER|PULLI", name):
        return ""
    if m := re.match(r"(?:DEVANAGARI|BENGALI|GURMUKHI|GUJARATI|ORIYA|TAMIL|TELUGU|KANNADA|MALAYALAM|SINHALA) LETTER (?:SHORT |CANDRA |VOCALIC |CHILLU )?([A-Z]+)$", name):
        x = m[1].lower()
        return x if re.fullmatch("[aeiou]+|ai|au", x) else x.removesuffix("a")
    if m := re.match(r"(?:CYRILLIC|GREEK) (SMALL|CAPITAL) LETTER (?:SHORT |FINAL )?([A-Z]+)", name):
        x = m[2].lower()
        if "GREEK" in name:
            x = {"theta": "th", "phi": "ph", "chi": "ch", "psi": "ps", "eta": "e", "omega": "o", "upsilon": "u", "xi": "x"}.get(x, x[:1])
        elif re.fullmatch("e[lmnrsf]", x):
            x = x[1:]
        elif x in ("hard", "soft"):
            x = ""
        elif len(x) > 1 and x[-1] == "e" and x not in ("ie",):
            x = x[:-1]
        elif x in ("ka", "ha", "sha", "shcha"):
            x = x[:-1]
        return {"ie": "e", "yeru": "y", "gh": "g"}.get(x, x)
    if m := re.match(r"HANGUL SYLLABLE ([A-Z]+)", name):
        return m[1].lower()
    if m := re.match(r"(?:HIRAGANA|KATAKANA) LETTER (?:SMALL )?([A-Z]+)", name):
        return m[1].lower()
    return "".join(x for x in unicodedata.normalize("NFKD", c) if ord(x) < 128)


@cache
def _latin() -> dict[int, str]:
    a, b, longer = latin_table()
    return {ord(x): y for x, y in [*zip(a, b), *longer]}


def to_ascii(s: str | None) -> tuple[str, bool]:
    """(lower-case ASCII text, whether it had a character of another script)."""
    if not s:
        return "", False
    if not _NON_LATIN.search(s):
        return "".join(x if ord(x) < 128 else _latin().get(ord(x), "") for x in s).lower(), False
    for a, b in MALAYALAM.items():
        s = s.replace(a, b)
    out = "".join(_latin().get(ord(x)) or romanised(x) for x in s)
    if _TAMIL.search(s):
        out = out.replace("c", "s")
    return out.replace("oN", "o").replace("N", "n").lower(), True


def _romanise(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: to_ascii(s)[0])


def ascii_column(c: Column) -> Column:
    """``c`` as lower-case ASCII: native for Latin text; other scripts alone go to Python."""
    romanise = F.pandas_udf(_romanise, "string")
    c = F.coalesce(c, F.lit(""))
    other = F.when(is_non_latin(c), c).otherwise(F.lit(""))
    return F.when(is_non_latin(c), romanise(other)).otherwise(fold_latin(c))
