"""Tokenizers and token-list expressions; all stay inside the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwire.functions import patterns as P
from siftwire.functions import wordlists as W

TOKENIZERS = ("regex", "whitespace")


def tokenize_regex(col: Column) -> Column:
    """Words of letters, digits and underscore, with one inner apostrophe part."""
    text = F.coalesce(col, F.lit(""))
    return F.regexp_extract_all(text, F.lit(P.WORD_TOKEN), F.lit(0))


def tokenize_whitespace(col: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), P.SPACES), "")


def tokenize(col: Column, backend: str = "regex") -> Column:
    name = backend.lower()
    if name == "regex":
        return tokenize_regex(col)
    if name == "whitespace":
        return tokenize_whitespace(col)
    raise ValueError(f"unknown tokenizer '{backend}', supported: {', '.join(TOKENIZERS)}")


def detokenize(tokens: Column, separator: str = " ") -> Column:
    return F.array_join(tokens, separator)


@dataclass(frozen=True)
class NormalizeOptions:
    """Switches of token normalization.

    ``lemmas`` and ``stem`` act through a word table (see ``operators.lexicon``), the rest
    are expressions. A lemma table wins over stemming. ``lemmatize`` is None for "where a table is given".
    """

    remove_stopwords: bool = True
    language: str = "english"
    extra_stopwords: tuple[str, ...] = ()
    keep_words: tuple[str, ...] = W.NEGATIONS
    slang: bool = True
    hinglish: bool = True
    min_length: int = 2
    max_length: int = 50
    lemmatize: bool | None = None
    stem: bool = False

    def dictionary(self) -> dict[str, str]:
        return {**(W.SLANG if self.slang else {}), **(W.HINGLISH if self.hinglish else {})}

    def stop_list(self) -> list[str]:
        if not self.remove_stopwords:
            return []
        return W.stopwords(self.language, self.extra_stopwords, self.keep_words)


def token_fold(tokens: Column) -> Column:
    """Drop empty tokens, lowercase and strip the others."""
    kept = F.array_remove(tokens, "")
    return F.transform(kept, lambda t: F.btrim(F.lower(t), F.lit(P.SPACE_CHARS)))


def _expand(token: Column, dictionary: dict[str, str]) -> Column:
    # The IN test is a hash probe; the map, which Spark scans, is read for hits only.
    pairs = [F.lit(part) for item in dictionary.items() for part in item]
    return F.when(token.isin(*dictionary), F.create_map(*pairs)[token]).otherwise(token)


def expand_slang(tokens: Column, dictionary: dict[str, str] | None = None) -> Column:
    """Replace known short forms; an expansion with spaces stays one token."""
    words = NormalizeOptions().dictionary() if dictionary is None else dictionary
    return F.transform(tokens, lambda t: _expand(t, words)) if words else tokens


def remove_stopwords(tokens: Column, words: list[str] | None = None) -> Column:
    stop = W.stopwords() if words is None else words
    return F.filter(tokens, lambda t: ~t.isin(*stop)) if stop else tokens


def token_length_filter(tokens: Column, least: int = 2, most: int = 50) -> Column:
    return F.filter(tokens, lambda t: F.length(t).between(least, most))


def normalize_tokens(tokens: Column, options: NormalizeOptions = NormalizeOptions(), bare: bool = False) -> Column:
    """Fold, expand, drop stop words, filter by length: one transform and one filter.

    ``bare`` tokens have no white space at their ends, as those of ``tokenize``; there is nothing to strip then,
    and stripping costs more than all the rest.
    """
    dictionary, stop = options.dictionary(), options.stop_list()

    def rewrite(token):
        folded = F.lower(token) if bare else F.btrim(F.lower(token), F.lit(P.SPACE_CHARS))
        return _expand(folded, dictionary) if dictionary else folded

    def wanted(token):
        fits = F.length(token).between(options.min_length, options.max_length)
        return fits & ~token.isin(*stop) if stop else fits

    return F.filter(F.transform(F.array_remove(tokens, ""), rewrite), wanted)


def spam_keywords(tokens: Column) -> Column:
    """Tokens that are suspicious words, in order and with repeats."""
    return F.filter(tokens, lambda t: F.lower(t).isin(*W.SPAM_KEYWORDS))


def spam_keyword_count(tokens: Column) -> Column:
    return F.size(spam_keywords(tokens))


def word_ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All runs of ``low`` to ``high`` neighbouring tokens, joined by a space."""

    def runs(n):
        if n == 1:
            return tokens
        if n == 2:
            pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
            return F.zip_with(
                F.slice(tokens, F.lit(1), pairs),
                F.slice(tokens, F.lit(2), pairs),
                lambda a, b: F.concat(a, F.lit(" "), b),
            )
        count = F.size(tokens) - F.lit(n - 1)
        starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))

    parts = [runs(n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def char_ngrams(chars: Column, low: int = 1, high: int = 2) -> Column:
    """All runs of ``low`` to ``high`` neighbouring characters of an array of characters."""

    def runs(n):
        if n == 1:
            return chars
        count = F.size(chars) - F.lit(n - 1)
        starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda i: F.array_join(F.slice(chars, i, n), ""))

    parts = [runs(n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)
