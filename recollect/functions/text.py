"""Column expressions over text. All stay in the JVM except Unicode composition."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space at the ends of a value (Unicode white space, information separators, BOM).
WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
WORD = r"[\p{L}\p{N}]+"


def strip_white(c: Column) -> Column:
    """``c`` without white space at its ends; null stays null."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def term_of(c: Column) -> Column:
    """Lower case without white space at the ends; null for null and blank values."""
    t = F.lower(strip_white(c))
    return F.when(F.length(t) > 0, t)


def letters_digits(c: Column) -> Column:
    """Only the letters and digits (categories L and N) of ``c``, lower-cased."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def code_unit_key(c: Column) -> Column:
    """Sort key in UTF-16 code-unit order."""
    return F.encode(c, "UTF-16BE")


def code_unit_length(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def cut_units(c: Column, n: int) -> Column:
    """The longest beginning of ``c`` of at most ``n`` UTF-16 code units; a character of two units is never cut in half."""
    head = F.substring(c, 1, n)
    fits = F.aggregate(F.split(head, ""), F.lit(""), lambda acc, x: F.when(code_unit_length(F.concat(acc, x)) <= n, F.concat(acc, x)).otherwise(acc))
    return F.when(head.rlike(_ASTRAL), fits).otherwise(head)


def units(c: Column) -> Column:
    """``code_unit_length``, quick where every character is one unit."""
    return F.when(c.rlike(_ASTRAL), code_unit_length(c)).otherwise(F.length(c))


# Fixed value: the characters of two UTF-16 code units.
_ASTRAL = r"[\x{10000}-\x{10ffff}]"


@F.pandas_udf(T.StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def composed(c: Column) -> Column:
    """NFC of ``c``."""
    return _compose(c)


# Fixed value: a token is a run of letters and digits with inner apostrophes.
TOKEN = "[\\p{L}\\p{N}]+(?:['’][\\p{L}\\p{N}]+)*"
# Characters that composition (NFC) may change, as a superset; only texts holding one leave the JVM.
_COMPOSABLE = (
    r"[\p{M}\x{374}\x{37e}\x{387}\x{958}-\x{95f}\x{9dc}-\x{9df}\x{a33}-\x{a5e}\x{b5c}\x{b5d}\x{f43}-\x{fb9}\x{1100}-\x{11ff}\x{1f71}-\x{1ffd}"
    r"\x{2000}\x{2001}\x{2126}\x{212a}\x{212b}\x{2329}\x{232a}\x{2adc}\x{f900}-\x{fb4e}\x{1d15e}-\x{1d1c0}\x{2f800}-\x{2fa1d}]"
)


# All of them lie in this one range, which is quicker to look for.
_BEYOND = r"[\x{300}-\x{10ffff}]"


def nfc(c: Column) -> Column:
    """NFC of ``c``; null stays null."""
    return F.coalesce(composed(F.when(c.rlike(_BEYOND) & c.rlike(_COMPOSABLE), c)), c)


def tokens(c: Column, compose: bool = True) -> Column:
    """Tokens of ``c`` in order, with repeats; null has none."""
    text = F.lower(nfc(c) if compose else c)
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), F.array().cast("array<string>"))


def query_tokens(text: str) -> list[str]:
    """Tokens of a query text, on the driver."""
    import regex

    return regex.findall(TOKEN, unicodedata.normalize("NFC", text).lower())


def phrase(toks: Column) -> Column:
    """Tokens joined by single spaces."""
    return F.array_join(toks, " ")


def contains_phrase(toks: Column, wanted: list[str]) -> Column:
    """Whether the tokens hold ``wanted`` in a row."""
    if not wanted:
        return F.lit(False)
    return F.instr(F.concat(F.lit(" "), phrase(toks), F.lit(" ")), " " + " ".join(wanted) + " ") > 0


def hits(wanted: list[str], have: Column) -> Column:
    """The wanted tokens, repeats kept, that ``have`` holds."""
    return F.filter(F.array(*map(F.lit, wanted)), lambda t: F.array_contains(have, t))


def clamp01(c: Column) -> Column:
    """``c`` limited to 0..1; NaN stays NaN."""
    return F.when(F.isnan(c), c).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def excerpt(c: Column, room: Column) -> Column:
    """``c`` cut to ``room`` characters, ending in dots where three fit."""
    cut = F.when(room >= 3, F.concat(F.substring(c, F.lit(1), room - 3), F.lit("..."))).otherwise(F.substring(c, F.lit(1), room))
    return F.when(F.length(c) > room, cut).otherwise(c)
