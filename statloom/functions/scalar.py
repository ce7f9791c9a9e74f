"""Column functions shared by operators. All stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters that no accent explains, and their plain forms.
STROKED = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ħ": "h", "Ħ": "H", "ı": "i"}
LIGATURES = {"æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "þ": "th", "Þ": "TH"}


def _accents() -> dict[str, str]:
    """Latin letters of which Unicode says that they are a plain letter with accents."""
    found = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for r in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in r}
    return {c: base for c, base in found.items() if base.isascii() and base.isalpha()}


_SINGLE = _accents() | STROKED
ACCENTED = "".join(_SINGLE) + "".join(map(chr, range(0x300, 0x370)))  # accents that stand by themselves go
PLAIN = "".join(_SINGLE.values())


def rounded(c: str | Column, digits: int) -> Column:
    """A double to so many digits, halves away from zero, as SQL engines round: of the binary value times 10 to the digits.

    F.round takes the shortest decimal that stands for the value, so 1.005 (which is less) becomes 1.01.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 10.0**digits) / 10.0**digits


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """scale * part / whole; null where whole is null or zero."""
    return F.lit(scale) * part / F.nullif(whole.cast("double"), F.lit(0.0))


def normal_name(c: Column) -> Column:
    """Lower case without accents; other characters than letters and digits become single spaces."""
    for double, plain in LIGATURES.items():
        c = F.replace(c, F.lit(double), F.lit(plain))
    return F.trim(F.regexp_replace(F.lower(F.translate(c, ACCENTED, PLAIN)), "[^a-z0-9]+", " "))


def t_score(value: Column, mean: Column, deviation: Column) -> Column:
    """50 + 10 z, between 1 and 99, one decimal; null without deviation."""
    clamped = F.least(F.greatest(50 + 10 * (value - mean) / F.nullif(deviation, F.lit(0.0)), F.lit(1.0)), F.lit(99.0))
    return F.when(deviation != 0, rounded(clamped, 1))


def trajectory(delta: Column) -> Column:
    return F.when(delta >= 10, "heating").when(delta <= -10, "cooling").otherwise("developing")


def direction(delta: Column) -> Column:
    return F.when(delta >= 10, "rising").when(delta <= -10, "falling").otherwise("steady")


def band(percentile: Column) -> Column:
    """Named bands from 90, 75, 60, 50 and 35 on."""
    return F.when(percentile >= 90, "elite").when(percentile >= 75, "strong").when(percentile >= 60, "above average").when(percentile >= 50, "average").when(percentile >= 35, "below average").otherwise("poor")


def conviction(delta: Column) -> Column:
    """-5 to 5 by steps at 5, 20, 35, 55 and 80."""
    steps = sum(((F.abs(delta) >= x).cast("int") for x in (5, 20, 35, 55, 80)), F.lit(0))
    return (steps * F.signum(delta)).cast("int")


def bridge_games(sport: Column) -> Column:
    """Games until a season stands by itself."""
    return F.when(sport == "NBA", 8).when(sport == "NFL", 2).when(sport == "FOOTBALL", 4).otherwise(10)


def content_hash(c: Column) -> Column:
    """The first half of SHA-256 of the text with single spaces."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(c, r"\s+", " ")).cast("binary"), 256), 1, 32)


def key_of(c: Column) -> Column:
    """A ranking key: equal on every engine, whatever the order of a floating sum."""
    return c.cast("decimal(18,6)")


def ordinal(c: Column) -> Column:
    """1st, 2nd, 3rd, 4th, ..., 11th, ..., 21st."""
    last = c % 10
    suffix = F.when((c % 100).isin(11, 12, 13), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(c.cast("string"), suffix)
