"""Cleaning steps as column expressions, and the whole cleaner as one DataFrame step."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwire.functions import patterns as P


@dataclass(frozen=True)
class CleanOptions:
    """Switches and replacement tokens of the cleaner; the defaults run every step."""

    strip_html: bool = True
    fold_unicode: bool = True
    mask_urls: bool = True
    mask_emails: bool = True
    mask_phones: bool = True
    handle_emoji: bool = True
    mask_currency: bool = True
    mask_numbers: bool = True
    lowercase: bool = True
    drop_special: bool = True
    squeeze_repeats: bool = True
    squeeze_spaces: bool = True
    emoji_mode: str = "replace"
    url_token: str = " __URL__ "
    email_token: str = " __EMAIL__ "
    phone_token: str = " __PHONE__ "
    emoji_token: str = " __EMOJI__ "
    currency_token: str = " __CURRENCY__ "
    number_token: str = " __NUM__ "
    min_length: int = 1


def _replace(col: Column, pattern: str, token: str) -> Column:
    return F.regexp_replace(col, pattern, token.replace("\\", "\\\\").replace("$", "\\$"))


def clean_guard(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def strip_html_tags(col: Column) -> Column:
    return _replace(col, P.HTML_TAG, " ")


def _decoder(unescape: bool, fold: str | None):
    """Arrow UDF for the two steps Spark has no expression for: HTML entities and NFKD."""

    @F.pandas_udf("string")
    def decode(texts):
        import html

        def marks(text):
            if fold == "combining":
                return {ord(c): None for c in set(text) if unicodedata.combining(c)}
            return {ord(c): None for c in set(text) if unicodedata.category(c) == "Mn"}

        def one(text):
            if text is None:
                return None
            if unescape and "&" in text:
                text = html.unescape(text)
            if fold and not text.isascii():
                text = unicodedata.normalize("NFKD", text)
                if not text.isascii():
                    text = text.translate(marks(text))
            return text

        return texts.map(one, na_action="ignore")

    return decode


@cache
def _single_folds(fold: str) -> tuple[str, str, str]:
    """(characters, what each becomes, class of characters): those that folding turns into one character or none.

    None of them is a mark, so a text of these and ASCII folds character by character. The class also has the
    characters that stay as they are; those that go are last, without a counterpart.
    """
    single: dict[str, str] = {}
    for first, last in P.FOLD_BLOCKS:
        for c in map(chr, range(first, last + 1)):
            parts = unicodedata.normalize("NFKD", c)
            left = [x for x in parts if not (unicodedata.combining(x) if fold == "combining" else unicodedata.category(x) == "Mn")]
            if len(left) < 2 and not unicodedata.combining(c) and not any(map(unicodedata.combining, left)):
                single[c] = "".join(left)
    changed = sorted((c for c in single if single[c] != c), key=lambda c: (not single[c], c))
    return "".join(changed), "".join(single[c] for c in changed), P.ranges(map(ord, single))


def decode_text(col: Column, unescape: bool = True, fold: str | None = "nonspacing") -> Column:
    """Resolve HTML entities and / or fold accents.

    Only texts that hold an ampersand or a character that does not fold to a single one travel to Python;
    all others stay in the JVM. ``fold`` names what is dropped after NFKD: category Mn
    (``nonspacing``) or characters with a combining class (``combining``).
    """
    needed, here = F.lit(False), col
    if unescape:
        needed = needed | F.contains(col, F.lit("&"))
    if fold:
        old, new, known = _single_folds(fold)
        needed = needed | col.rlike(rf"{P.NON_ASCII}(?<![{known}])")
        here = F.when(col.rlike(P.NON_ASCII), F.translate(col, old, new)).otherwise(col)
    return F.coalesce(_decoder(unescape, fold)(F.when(needed, col)), here)


def html_unescape(col: Column) -> Column:
    return decode_text(col, unescape=True, fold=None)


def fold_unicode(col: Column) -> Column:
    return decode_text(col, unescape=False, fold="nonspacing")


def may_hold_url(col: Column) -> Column:
    """Cheap test that every text with a link passes."""
    return F.contains(col, F.lit(P.URL_MARK)) | col.rlike(P.URL_DOT)


def mask_urls(col: Column, token: str = " __URL__ ") -> Column:
    return _replace(col, P.URL, token)


def mask_emails(col: Column, token: str = " __EMAIL__ ") -> Column:
    return _replace(col, P.EMAIL, token)


def mask_phones(col: Column, token: str = " __PHONE__ ") -> Column:
    return _replace(col, P.PHONE, token)


def handle_emoji(col: Column, mode: str = "replace", token: str = " __EMOJI__ ") -> Column:
    """``replace`` emoji runs by a token, ``remove`` them, or (any other mode) keep them."""
    if mode == "replace":
        return _replace(col, P.EMOJI, token)
    if mode == "remove":
        return _replace(col, P.EMOJI, "")
    return col


def mask_currency(col: Column, token: str = " __CURRENCY__ ") -> Column:
    return _replace(col, P.CURRENCY, token)


def mask_numbers(col: Column, token: str = " __NUM__ ") -> Column:
    return _replace(col, P.NUMBER, token)


def lowercase(col: Column) -> Column:
    return F.lower(col)


def drop_special_chars(col: Column) -> Column:
    return _replace(col, P.SPECIAL, " ")


def squeeze_repeats(col: Column) -> Column:
    return F.regexp_replace(col, P.REPEATED, "$1$1")


def squeeze_spaces(col: Column) -> Column:
    return F.trim(_replace(col, P.SPACES, " "))


def min_length(col: Column, least: int = 1) -> Column:
    return F.when(F.length(col) < least, F.lit("")).otherwise(col)


def clean_text(
    df: DataFrame,
    text_col: str = "text",
    out_col: str = "cleaned_text",
    options: CleanOptions = CleanOptions(),
) -> DataFrame:
    """Add ``out_col``: the text after every enabled step, in the fixed order.

    Each regular expression is applied once per row; a step whose result is read more
    than once sits in its own projection, so the optimizer does not repeat it.
    """
    o = options
    col = clean_guard(F.col(text_col))
    if o.strip_html:
        col = strip_html_tags(col)
    if o.strip_html or o.fold_unicode:
        df = df.withColumn(out_col, col)
        col = decode_text(
            F.col(out_col), unescape=o.strip_html, fold="nonspacing" if o.fold_unicode else None
        )
    df = df.withColumn(out_col, col)
    here = F.col(out_col)
    # Cheap tests spare most rows the link, address, emoji, phone, money and number patterns.
    if o.mask_urls:
        df = df.withColumn(out_col, F.when(may_hold_url(here), mask_urls(here, o.url_token)).otherwise(here))
    if o.mask_emails:
        df = df.withColumn(
            out_col,
            F.when(F.contains(here, F.lit("@")), mask_emails(here, o.email_token)).otherwise(here),
        )
    emoji = (
        (lambda c: handle_emoji(c, o.emoji_mode, o.emoji_token)) if o.handle_emoji else (lambda c: c)
    )
    col = mask_phones(here, o.phone_token) if o.mask_phones else here
    col = emoji(col)
    if o.mask_currency:
        col = mask_currency(col, o.currency_token)
    if o.mask_numbers:
        col = mask_numbers(col, o.number_token)
    df = df.withColumn(out_col, F.when(here.rlike(P.ANY_DIGIT), col).when(here.rlike(P.NON_ASCII), emoji(here)).otherwise(here))
    col = F.col(out_col)
    if o.lowercase:
        col = lowercase(col)
    merged = o.drop_special and o.squeeze_spaces
    if merged:
        # Same end result in one pass: dropped characters and white space end as one space.
        col = _replace(col, P.SPECIAL_OR_SPACES, " ")
    elif o.drop_special:
        col = drop_special_chars(col)
    if o.squeeze_repeats:
        col = squeeze_repeats(col)
    if o.squeeze_spaces:
        col = F.trim(col) if merged else squeeze_spaces(col)
    df = df.withColumn(out_col, col)
    if o.min_length > 1:
        df = df.withColumn(out_col, min_length(F.col(out_col), o.min_length))
    return df
