"""The whole text pipeline: clean, tokenize, normalize, describe."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwire.functions import profile as R
from siftwire.functions import tokens as K
from siftwire.functions.cleaning import CleanOptions, clean_text
from siftwire.operators import lexicon as L


@dataclass(frozen=True)
class PreprocessOptions:
    """Stage switches; they choose expressions while the plan is built."""

    clean: CleanOptions = CleanOptions()
    normalize: K.NormalizeOptions = K.NormalizeOptions()
    tokenizer: str = "regex"
    enable_cleaning: bool = True
    enable_tokenization: bool = True
    enable_normalization: bool = True
    extract_metadata: bool = True
    join_tokens: bool = True
    separator: str = " "


def preprocess(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    options: PreprocessOptions = PreprocessOptions(),
    lemmas: DataFrame | None = None,
) -> DataFrame:
    """Add cleaned text, token lists, final text, counts, flags and ratios to every row.

    ``lemmas(form, pos, lemma)`` is the word table that lemmatization needs, of which ``lexicon.default_lemmas``
    makes a small one; without a table tokens stay as they are, unless ``lemmatize`` is asked for, which then fails. With expressions only, the plan
    has no shuffle.
    """
    o = options
    raw = F.coalesce(F.col(text_col), F.lit(""))
    if o.enable_cleaning:
        df = clean_text(df, text_col, "cleaned_text", o.clean)
    else:
        df = df.withColumn("cleaned_text", raw)
    backend = o.tokenizer if o.enable_tokenization else "whitespace"
    df = df.withColumn("tokens", K.tokenize(F.col("cleaned_text"), backend))
    n = o.normalize
    if o.enable_normalization:
        df = df.withColumn("normalized_tokens", K.normalize_tokens(F.col("tokens"), n, bare=True))
        if n.lemmatize and lemmas is None:
            raise ValueError("lemmatize needs a table of lemmas; lexicon.default_lemmas makes one")
        if lemmas is not None and n.lemmatize is not False:
            df = L.lemmatize(df, lemmas, "normalized_tokens", id_col)
        elif n.stem:
            df = L.stem(df, "normalized_tokens", id_col)
    else:
        df = df.withColumn("normalized_tokens", F.col("tokens"))
    final = (
        K.detokenize(F.col("normalized_tokens"), o.separator) if o.join_tokens else F.col("cleaned_text")
    )
    df = df.withColumns(
        {
            "final_text": final,
            "spam_keywords": K.spam_keywords(F.col("normalized_tokens")),
            "original_length": F.length(raw),
            "cleaned_length": F.length("cleaned_text"),
            "token_count": F.size("normalized_tokens"),
        }
    ).withColumn("spam_keyword_count", F.size("spam_keywords"))
    if o.extract_metadata:
        return df.withColumns({**R.contact_flags(F.col(text_col)), **R.ratios(F.col(text_col))})
    return df.withColumns(
        {
            **{name: F.lit(False) for name in R.contact_flags(raw)},
            **{name: F.lit(0.0) for name in R.ratios(raw)},
        }
    )


def preprocess_to_text(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    options: PreprocessOptions = PreprocessOptions(),
    lemmas: DataFrame | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Only the id, the kept columns and the final text; the rest is pruned from the plan."""
    return preprocess(df, text_col, id_col, options, lemmas).select(id_col, *keep, "final_text")
