"""Unicode folding as built-in expressions: the maps come from the character database, the work is done by translate()."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

#: Code points looked at: the basic plane up to the Hangul syllables, which fold to parts of themselves and stay, and the compatibility forms after them.
_PLANES = (range(0x80, 0xAC00), range(0xF900, 0x10000))


def plain(text: str, form: str) -> str:
    """What the expressions give, by the library: the form, without marks if it is a decomposed one."""
    out = unicodedata.normalize(form, text)
    return "".join(c for c in out if unicodedata.category(c)[0] != "M") if form.endswith("D") else out


@cache
def folds(form: str) -> tuple[dict[str, str], dict[str, str]]:
    """Characters that one character stands for, and those that take several (or none), in a normal form."""
    one, more = {}, {}
    for c in (chr(k) for plane in _PLANES for k in plane):
        out = plain(c, form)
        if out != c and unicodedata.category(c)[0] != "M":
            (one if len(out) == 1 else more)[c] = out
    return one, more


def _folded(x: Column, form: str) -> Column:
    one, more = folds(form)
    each = F.translate(x, "".join(one), "".join(one.values()))
    table = F.split(F.lit("\x01".join(c + out for c, out in more.items())), "\x01")  # one literal, whatever the number of pairs
    long_way = F.aggregate(table, each, lambda s, pair: F.replace(s, F.substring(pair, 1, 1), F.substring(pair, 2, 99)))
    rare = x.rlike("[" + "".join(f"\\x{{{ord(c):x}}}" for c in more) + "]")
    return F.when(~x.rlike(r"[^\x00-\x7F]"), x).when(rare, long_way).otherwise(each)  # most strings are ASCII, few have characters that take several


def without_marks(x: Column) -> Column:
    """Compatibility forms replaced and diacritics dropped; Hangul syllables stay."""
    return F.regexp_replace(_folded(x, "NFKD"), r"\p{M}+", "")


def compatible(x: Column) -> Column:
    """Compatibility forms (wide letters, ligatures, ...) replaced, one character at a time: marks that stand alone are not composed."""
    return _folded(x, "NFKC")


def short_vowels(x: Column) -> Column:
    """Romanised long vowels in their short form."""
    return F.regexp_replace(F.regexp_replace(x, "ou|oo|oh(?![aeiouy])", "o"), "uu", "u")


def person_key(x: Column) -> Column:
    """The runs of letters and digits of a name, folded, with short vowels, sorted: spelling, case and order of its parts do not matter."""
    parts = F.filter(F.split(F.lower(without_marks(x)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_join(F.array_sort(F.transform(parts, short_vowels)), " ")
