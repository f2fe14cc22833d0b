"""Score messages into prediction-log rows."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwire.functions import vectors as V
from siftwire.operators import classifiers as C
from siftwire.operators import features as X
from siftwire.plans.preprocess import PreprocessOptions, preprocess
from siftwire.session import stored

logger = logging.getLogger(__name__)

# (texts with `final_text`, id column, small columns to keep) -> id, keep, both probabilities
Scorer = Callable[[DataFrame, str, tuple[str, ...]], DataFrame]

#: Tells rows apart that share an id but not the text; rows that repeat both are one message.
TEXT_KEY = "text_key"
FACTS = ("original_length", "token_count", "spam_keyword_count", "has_url", "uppercase_ratio")


def naive_bayes_scorer(model: C.NaiveBayes) -> Scorer:
    def score(texts, id_col, keep):
        return C.score_naive_bayes(model, texts, "final_text", id_col, keep)

    return score


def classifier_scorer(
    classifier: C.Classifier, vocabulary: DataFrame, options: X.TfidfOptions = X.CLEANED
) -> Scorer:
    def score(texts, id_col, keep):
        counts = X.term_counts(texts, "final_text", id_col, options, keep, outer=True, packed=True)
        vectors = X.tfidf_vectors(counts, vocabulary, id_col, keep, options)
        return classifier.score(vectors).select(id_col, *keep, "ham_probability", "spam_probability")

    return score


def batch_scorer(load: Callable[[], Callable], batch_size: int = 32) -> Scorer:
    """Scorer for any model that maps raw texts to ``[ham, spam]`` logits.

    ``load`` runs once per Python worker and returns a function from a list of texts to an
    array of logits; batches are streamed through it. Where the model fails on a batch, its texts are
    tried one by one, and a text that it fails on has null probabilities: the job goes on.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    def make():
        model = load()

        def one(text: str):
            try:
                return list(map(float, model([text])[0]))
            except Exception:  # noqa: BLE001 - one text, one missing score
                return [float("nan"), float("nan")]

        def run(texts):
            try:
                return np.asarray(model(list(texts)))
            except Exception:  # noqa: BLE001 - the batch is tried again text by text
                return np.array([one(t) for t in texts])

        return run

    udf = predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)

    def score(texts, id_col, keep):
        logits = texts.withColumn("logits", udf("text"))
        lead = F.nanvl(F.col("logits")[1] - F.col("logits")[0], F.lit(None).cast("double"))  # softmax of two logits
        return logits.select(
            id_col,
            *keep,
            (F.lit(1.0) / (F.lit(1.0) + F.exp(lead))).alias("ham_probability"),
            (F.lit(1.0) / (F.lit(1.0) + F.exp(-lead))).alias("spam_probability"),
        )

    return score


def decide(spam: Column, threshold: float | Column = 0.5) -> Column:
    """The label; ``error`` where there is no probability."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(spam.isNull(), "error").when(spam >= limit, "spam").otherwise("ham")


def score_messages(
    df: DataFrame,
    scorer: Scorer,
    model_name: str,
    threshold: float = 0.5,
    text_col: str = "text",
    id_col: str = "doc_id",
    options: PreprocessOptions = PreprocessOptions(),
    lemmas: DataFrame | None = None,
    raw_text: bool = False,
    explain: Callable[[DataFrame, str, str], DataFrame] | None = None,
) -> DataFrame:
    """Preprocess, score and decide: one log row per message, without the text itself.

    ``confidence`` is the larger probability; away from a threshold of one half it may belong
    to the other label. Only the few facts kept in ``metadata`` travel with the terms. Messages
    that share an id are scored each; a message delivered twice, id and text, is one row.

    ``explain(messages, text column, key column)`` gives (key, method, word_importances): they become the column
    ``explanation``, null for messages that could not be explained. Where explaining fails altogether, the
    scores stand and every explanation is null.
    """
    ready = preprocess(df, text_col, id_col, options, lemmas)
    key = F.xxhash64(text_col).alias(TEXT_KEY)
    raw = [F.col(text_col).alias("text")] if raw_text else []
    texts = ready.select(id_col, *FACTS, key, *raw, "final_text")
    scored = scorer(texts, id_col, (*FACTS, TEXT_KEY))
    decided = scored.select(
        id_col,
        TEXT_KEY,
        decide(F.col("spam_probability"), threshold).alias("prediction"),
        F.greatest("spam_probability", "ham_probability").alias("confidence"),
        "spam_probability",
        "ham_probability",
        F.lit(model_name).alias("model_used"),
        F.struct(*FACTS).alias("metadata"),
    )
    return decided if explain is None else _explained(decided, df, explain, text_col, id_col)


EXPLANATION = "struct<method:string,word_importances:array<struct<word:string,score:double,is_spam_indicator:boolean>>>"


def _explained(decided: DataFrame, df: DataFrame, explain, text_col: str, id_col: str) -> DataFrame:
    """``decided`` with its explanations, computed and stored first so that their failure is known."""
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(text_col)).alias("__message")
    messages = df.select(key, F.col(text_col)).dropDuplicates(["__message"])
    try:
        told = explain(messages, text_col, "__message").filter(F.col("prediction") != "error")
        told = stored(told.select("__message", F.struct("method", "word_importances").cast(EXPLANATION).alias("explanation")), "explanations")
    except Exception as error:  # noqa: BLE001 - an explanation never costs a score
        logger.warning("explanations left out: %s", str(error).split("\n")[0])
        return decided.withColumn("explanation", F.lit(None).cast(EXPLANATION))
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(TEXT_KEY))
    return decided.withColumn("__message", key).join(told, "__message", "left").drop("__message")


def measured(scored: DataFrame) -> DataFrame:
    """``scored``, computed now and stored, with ``processing_time_ms``: what the job took for each row on average."""
    started = time.perf_counter()
    done = stored(scored.drop("processing_time_ms"), "measured")
    spent = (time.perf_counter() - started) * 1000
    return done.withColumn("processing_time_ms", F.lit(spent / max(1, done.count())))


def score_batch(
    df: DataFrame,
    scorer: Scorer,
    model_name: str,
    threshold: float = 0.5,
    text_col: str = "text",
    id_col: str = "doc_id",
    options: PreprocessOptions = PreprocessOptions(),
    lemmas: DataFrame | None = None,
    ms_per_row: float | None = None,
) -> DataFrame:
    """Scores for the batch path: no metadata, tagged ``batch``, mean time if given; ``measured`` finds it."""
    ready = preprocess(df, text_col, id_col, options, lemmas)
    ready = ready.select(id_col, F.xxhash64(text_col).alias(TEXT_KEY), F.col(text_col).alias("text"), "final_text")
    scored = scorer(ready, id_col, (TEXT_KEY,))
    return scored.select(
        id_col,
        TEXT_KEY,
        decide(F.col("spam_probability"), threshold).alias("prediction"),
        F.greatest("spam_probability", "ham_probability").alias("confidence"),
        "spam_probability",
        "ham_probability",
        F.lit(model_name).alias("model_used"),
        F.lit("batch").alias("source"),
        F.lit(ms_per_row).cast("double").alias("processing_time_ms"),
    )


class Scorers:
    """Scorers by name, built on first use and kept."""

    def __init__(self, builders: dict[str, Callable[[], Scorer]], default: str = "logistic_regression"):
        self._builders = dict(builders)
        self._built: dict[str, Scorer] = {}
        self.default = default

    def names(self) -> list[str]:
        return sorted(self._builders)

    def get(self, name: str | None = None) -> Scorer:
        name = name or self.default
        if name not in self._builders:
            raise FileNotFoundError(f"no model '{name}', train it first")
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def score(self, df: DataFrame, name: str | None = None, **kwargs) -> DataFrame:
        return score_messages(df, self.get(name), name or self.default, **kwargs)


def to_log(
    scored: DataFrame, messages: DataFrame, created_at: Column, source: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Prediction-log rows, one for each scored message. The batch path stores no text facts, only their defaults.

    Scores meet their message by id and text; a message delivered twice is one row.
    """
    single = "metadata" in scored.columns
    columns = {
        "has_url": F.col("metadata.has_url") if single else F.lit(False),
        "text_length": F.col("metadata.original_length") if single else F.lit(0),
        "spam_keyword_count": F.col("metadata.spam_keyword_count") if single else F.lit(0),
    }
    user = F.col("user_id").cast("string") if "user_id" in messages.columns else F.lit(None).cast("string")
    texts = messages.select(
        F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__key"), F.col(text_col).alias("input_text"), user.alias("user_id")
    ).dropDuplicates(["__id", "__key"])
    time_spent = F.col("processing_time_ms") if "processing_time_ms" in scored.columns else F.lit(0.0)
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col(TEXT_KEY) == F.col("__key"))
    return scored.dropDuplicates([id_col, TEXT_KEY]).join(texts, same).select(
        F.col(id_col).cast("string").alias("id"),
        "user_id",
        "input_text",
        "prediction",
        "confidence",
        "spam_probability",
        "ham_probability",
        "model_used",
        F.coalesce(time_spent, F.lit(0.0)).alias("processing_time_ms"),
        *[c.alias(k) for k, c in columns.items()],
        F.lit(source).alias("source"),
        created_at.alias("created_at"),
    )


def proba_argmax(df: DataFrame, logits_col: str) -> DataFrame:
    """Add softmax ``proba`` and the position ``label`` of its first maximum."""
    return df.withColumn("proba", V.softmax(F.col(logits_col))).withColumn("label", V.argmax(F.col("proba")))
