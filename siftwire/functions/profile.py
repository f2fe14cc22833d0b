"""Row features of the raw text, as column expressions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwire.functions import patterns as P
from siftwire.functions.cleaning import may_hold_url


def has_url(col: Column) -> Column:
    return F.coalesce(may_hold_url(col) & col.rlike(P.URL), F.lit(False))


def has_email(col: Column) -> Column:
    return F.coalesce(col.contains("@") & col.rlike(P.EMAIL), F.lit(False))


def has_phone(col: Column) -> Column:
    return F.coalesce(col.rlike(P.DIGIT) & col.rlike(P.PHONE), F.lit(False))


def has_currency(col: Column) -> Column:
    return F.coalesce(col.rlike(P.DIGIT) & col.rlike(P.CURRENCY), F.lit(False))


def _count(col: Column, char_class: str) -> Column:
    # Removing runs of the other characters is cheaper than one match per character.
    return F.length(F.regexp_replace(col, rf"[^{char_class}]++", ""))


@cache
def _other_digits() -> str:
    """Superscript and circled digits, found by rule, as ranges."""
    import sys

    found = [
        c
        for c in range(0x80, sys.maxunicode + 1)
        if chr(c).isdigit() and not chr(c).isdecimal()
    ]
    return P.ranges(found)


def uppercase_ratio(col: Column) -> Column:
    """Uppercase letters by letters."""
    text = F.coalesce(col, F.lit(""))
    return _count(text, r"\p{Lu}") / F.greatest(_count(text, r"\p{L}"), F.lit(1))


def digit_ratio(col: Column) -> Column:
    """Digits by characters; the long class of rare digits is tried on few rows only."""
    text = F.coalesce(col, F.lit(""))
    rare = F.when(text.rlike(r"\p{No}"), _count(text, _other_digits())).otherwise(0)
    plain = _count(text, "0123456789" + P.DIGIT)
    return (plain + rare) / F.greatest(F.length(text), F.lit(1))


def special_char_ratio(col: Column) -> Column:
    """Characters that are neither letter, number nor white space, by all characters."""
    text = F.coalesce(col, F.lit(""))
    return F.length(F.regexp_replace(text, rf"[\p{{L}}\p{{N}}{P.SPACE}]++", "")) / F.greatest(
        F.length(text), F.lit(1)
    )


def contact_flags(col: Column) -> dict[str, Column]:
    return {
        "has_url": has_url(col),
        "has_email": has_email(col),
        "has_phone": has_phone(col),
        "has_currency": has_currency(col),
    }


def ratios(col: Column) -> dict[str, Column]:
    return {
        "uppercase_ratio": uppercase_ratio(col),
        "digit_ratio": digit_ratio(col),
        "special_char_ratio": special_char_ratio(col),
    }
