"""Parsing of statutory phrases with built-in expressions alone."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words and units of deadlines, in natural order.
NUMBER_WORDS = {"een": 1, "één": 1, "twee": 2, "drie": 3, "vier": 4, "vijf": 5, "zes": 6, "zeven": 7, "acht": 8, "negen": 9, "tien": 10, "elf": 11, "twaalf": 12, "dertien": 13, "veertien": 14, "vijftien": 15, "zestien": 16, "zeventien": 17, "achttien": 18, "negentien": 19, "twintig": 20, "vierentwintig": 24, "achtenveertig": 48, "tweeënzeventig": 72, "tweeenzeventig": 72}
UNITS = {"uur": "hour", "uren": "hour", "dag": "day", "dagen": "day", "werkdag": "working day", "werkdagen": "working day", "kalenderdag": "day", "kalenderdagen": "day", "week": "week", "weken": "week", "maand": "month", "maanden": "month", "jaar": "year", "jaren": "year"}
UNDELAYED = r"(onverwijld|onmiddellijk|zo spoedig mogelijk|without undue delay)"
#: Typographic signs and what they stand for: quotes, dashes, spaces; letters of full width and ligatures.
_SIGNS = {"\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u00ab": '"', "\u00bb": '"', "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2212": "-", "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ", "\u3000": " "}
_SIGNS |= {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
_LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\u2026": "..."}
#: Letters with the marks that may follow them apart, as one: what composing does to Latin letters.
_COMPOSED = {unicodedata.decomposition(chr(c)): chr(c) for c in range(0xC0, 0x180) if " " in unicodedata.decomposition(chr(c)) and "<" not in unicodedata.decomposition(chr(c))}
_MARKS = sorted({d.split()[1] for d in _COMPOSED})


def folded(c: Column) -> Column:
    """Quotes, dashes and spaces in their plain form, ligatures and full width undone, Latin letters composed with their marks.

    The part of NFKC that concerns Latin text, in built-in functions; other scripts stay as they are.
    """
    out = F.translate(c, "".join(_SIGNS), "".join(_SIGNS.values()))
    for sign, letters in _LIGATURES.items():
        out = F.replace(out, F.lit(sign), F.lit(letters))
    composed = out
    for apart, whole in _COMPOSED.items():
        composed = F.replace(composed, F.lit("".join(chr(int(x, 16)) for x in apart.split())), F.lit(whole))
    marked = out.rlike("[" + "".join(f"\\x{{{m}}}" for m in _MARKS) + "]")
    return F.when(marked, composed).otherwise(out)


def normalise(c: Column) -> Column:
    """Folded, lower case, runs of space to one space, ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.lower(folded(c)), r"[ \t\r\n]+", " "))


def tokens(c: Column, least: int = 4) -> Column:
    """Lower-case letter runs (a-z and Latin-1 letters) of at least so many letters."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-zà-ÿ]+"), F.lit(0)), lambda w: F.length(w) >= least)


def deadline(c: Column) -> Column:
    """struct<value, unit> of the first deadline in a phrase, a number and unit after `binnen` or `uiterlijk`; `undelayed` for those without a number, else null."""
    return _once(normalise(c), _deadline)


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), x worked out once: normalising is a long expression."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _deadline(t: Column) -> Column:
    longest = lambda names: "|".join(sorted(names, key=len, reverse=True))
    pattern = rf"(?<![\p{{L}}\p{{N}}])(?:binnen|uiterlijk) (\d+|{longest(NUMBER_WORDS)}) ({longest(UNITS)})(?![\p{{L}}\p{{N}}])"
    number, unit = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    value = F.coalesce(number.try_cast("int"), F.try_element_at(words, number))
    found = F.struct(value.cast("double").alias("value"), F.try_element_at(units, unit).alias("unit"))
    return F.when(number != "", found).when(t.rlike(UNDELAYED), F.struct(F.lit(None).cast("double").alias("value"), F.lit("undelayed").alias("unit")))


def deadline_start(c: Column) -> Column:
    """What a deadline runs from: the words after `na` or `nadat` up to a sign or the end; empty if it names nothing."""
    return F.regexp_extract(normalise(c), r"(?<![\p{L}\p{N}])na(?:dat)? (.+?)(?:[,.;]|$)", 1)


def amount(c: Column) -> Column:
    """Euros of an amount such as `20 000 000 EUR` or a share such as `2 %`, as struct<value, kind>; else null."""
    return _once(normalise(c), _amount)


def _amount(t: Column) -> Column:
    share = F.regexp_extract(t, r"(\d+(?:,\d+)?) ?%", 1)
    money = F.coalesce(F.nullif(F.regexp_extract(t, r"€ ?(\d[\d .]*(?:,\d+)?)", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"(\d[\d .]*(?:,\d+)?) ?(?:eur|euro)(?![a-z])", 1), F.lit("")))
    number = lambda x: F.replace(F.regexp_replace(x, r"[ .]", ""), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(share != "", F.struct(number(share).alias("value"), F.lit("percent").alias("kind"))).when(money.isNotNull(), F.struct(number(money).alias("value"), F.lit("eur").alias("kind")))


def pair_hash(a: Column, b: Column) -> Column:
    """Sixteen hexadecimal digits that do not depend on the order of a and b."""
    low, high = F.least(a, b).cast("string"), F.greatest(a, b).cast("string")
    return F.substring(F.md5(F.concat_ws("|", low, high)), 1, 16)
