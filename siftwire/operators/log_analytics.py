"""Reports over the prediction log, and the feedback that corrects it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwire.functions import wordlists as W

MAX_HISTORY = 200


def summary(log: DataFrame, as_of: Column, models: Iterable[str] = ()) -> DataFrame:
    """Totals, spam share, mean confidence and time, and today's rows in one pass; ``models`` are those on offer."""
    total = F.count("id")
    spam = F.count_if(F.col("prediction") == "spam")
    return log.agg(
        total.alias("total_predictions"),
        spam.alias("total_spam"),
        (total - spam).alias("total_ham"),
        (spam / F.greatest(total, F.lit(1))).alias("spam_ratio"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.avg("processing_time_ms"), F.lit(0.0)).alias("avg_processing_time_ms"),
        F.count_if(F.col("created_at") >= F.date_trunc("day", as_of)).alias("predictions_today"),
        F.array(*[F.lit(m) for m in sorted(models)]).cast("array<string>").alias("models_available"),
    )


def timeline(
    log: DataFrame, as_of: Column, days: int = 7, labels: tuple[str, ...] = tuple(W.LABEL_CODES)
) -> DataFrame:
    """Rows per day and label over the last ``days`` days; the filter reaches the scan."""
    if not 1 <= days <= 90:
        raise ValueError("days must be between 1 and 90")
    recent = log.filter(F.col("created_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    return (
        recent.groupBy(F.to_date("created_at").alias("date"))
        .agg(
            *[F.count_if(F.col("prediction") == name).alias(name) for name in labels],
            F.count("id").alias("total"),
        )
        .orderBy("date")
    )


def timeline_long(log: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One row per day and label, for logs with labels not known in advance."""
    if not 1 <= days <= 90:
        raise ValueError("days must be between 1 and 90")
    recent = log.filter(F.col("created_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    return (
        recent.groupBy(F.to_date("created_at").alias("date"), "prediction")
        .agg(F.count("id").alias("count"))
        .orderBy("date", "prediction")
    )


def history(
    log: DataFrame, user_id, limit: int = 50, offset: int = 0, columns: tuple[str, ...] = (),
    largest_page: int = MAX_HISTORY,
) -> DataFrame:
    """One user's rows, newest first, a page at a time; only asked-for columns are read.

    A page above ``largest_page`` rows is refused, not cut.
    """
    if not 0 <= limit <= largest_page:
        raise ValueError(f"a page has at most {largest_page} rows, {limit} were asked for")
    mine = log.filter(F.col("user_id") == F.lit(user_id)).orderBy(F.col("created_at").desc(), F.col("id"))
    page = mine.offset(offset).limit(limit)
    return page.select(*columns) if columns else page


def point_lookup(log: DataFrame, key) -> DataFrame:
    return log.filter(F.col("id") == F.lit(key))


def feedback_ingest(batch: DataFrame, predictions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Add ``status`` to every submitted row: accepted, duplicate or not_found.

    The first row of a batch per prediction (by ``id``) counts, if the prediction exists and
    has no feedback yet. First rows come from an aggregate, so many repeats of one prediction
    do not meet in one task.
    """
    first = batch.groupBy("prediction_id").agg(F.min("id").alias("first_id"))
    known = first.join(
        predictions.select(F.col("id").alias("prediction_id"), F.lit(True).alias("exists")).distinct(),
        "prediction_id",
        "left",
    ).join(
        feedback.select("prediction_id", F.lit(True).alias("taken")).distinct(), "prediction_id", "left"
    )
    status = (
        F.when(F.col("exists").isNull(), "not_found")
        .when(F.col("taken").isNotNull() | (F.col("id") != F.col("first_id")), "duplicate")
        .otherwise("accepted")
    )
    # Two plain exchanges meet here, so adaptive execution can split a prediction with very many rows.
    named = batch.filter(F.col("prediction_id").isNotNull()).join(known, "prediction_id", "left")
    missing = batch.filter(F.col("prediction_id").isNull()).withColumn("status", F.lit("not_found"))
    named = named.withColumn("status", status).select(*batch.columns, "status")
    return named.unionByName(missing.select(*batch.columns, "status"))


def repeated_feedback(feedback: DataFrame) -> DataFrame:
    """Predictions with more than one feedback row."""
    return (
        feedback.groupBy("prediction_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    )


def dangling(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose reference points nowhere."""
    keys = parent.select(F.col(parent_key).alias(key))
    return child.filter(F.col(key).isNotNull()).join(keys, key, "left_anti")


def clear_missing_users(log: DataFrame, users: DataFrame) -> DataFrame:
    """Set ``user_id`` to null where the user is gone."""
    known = users.select(F.col("id").alias("user_id"), F.lit(True).alias("user_exists")).distinct()
    kept = F.when(F.col("user_exists"), F.col("user_id"))
    named = log.filter(F.col("user_id").isNotNull())
    done = named.join(known, "user_id", "left").withColumn("user_id", kept).select(*log.columns)
    # Rows without a user have nothing to look up; joined, they would all meet in one task.
    return done.unionByName(log.filter(F.col("user_id").isNull()))


def cascade_delete(feedback: DataFrame, predictions: DataFrame) -> DataFrame:
    """Feedback whose prediction still exists."""
    return feedback.join(
        predictions.select(F.col("id").alias("prediction_id")), "prediction_id", "left_semi"
    )


def key_checks(log: DataFrame, feedback: DataFrame, users: DataFrame) -> DataFrame:
    """Violations per rule, one row each."""
    rules = {
        "repeated_feedback": repeated_feedback(feedback),
        "dangling_feedback": dangling(feedback, log, "prediction_id"),
        "dangling_user": dangling(log, users, "user_id"),
    }
    parts = [
        df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
        for name, df in rules.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def model_benchmarks(results: DataFrame) -> DataFrame:
    return results.select("model_name", "accuracy", "precision", "recall", "f1", "roc_auc")


# ---- request validation -------------------------------------------------------------------

MAX_TEXT, MAX_COMMENT, MAX_BATCH = 10_000, 1_000, 100


def validate_requests(df: DataFrame, batch_col: str | None = None) -> DataFrame:
    """Add ``violations``: codes of every rule the row breaks.

    Rules apply to the columns present: text length, threshold range, label, comment length
    and, if ``batch_col`` names one, the batch size.
    """
    rules = []
    if "text" in df.columns:
        rules += [
            F.when(F.coalesce(F.length("text"), F.lit(0)) < 1, "text_too_short"),
            F.when(F.length("text") > MAX_TEXT, "text_too_long"),
        ]
    if "threshold" in df.columns:
        rules.append(F.when(~F.coalesce(F.col("threshold"), F.lit(0.5)).between(0.0, 1.0), "threshold_range"))
    if "correct_label" in df.columns:
        rules.append(
            F.when(~F.coalesce(F.col("correct_label").isin(*W.LABEL_CODES), F.lit(False)), "label_unknown")
        )
    if "comment" in df.columns:
        rules.append(F.when(F.length("comment") > MAX_COMMENT, "comment_too_long"))
    columns = df.columns
    if batch_col:
        sizes = df.groupBy(batch_col).agg(F.count(F.lit(1)).alias("batch_rows"))
        large = sizes.filter(F.col("batch_rows") > MAX_BATCH).select(batch_col, F.lit(True).alias("large"))
        df = df.join(large, batch_col, "left")
        rules.append(F.when(F.col("large"), "batch_too_large"))
    return df.withColumn("violations", F.array_compact(F.array(*rules))).select(*columns, "violations")


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("violations") == 0).drop("violations")


def quarantined(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("violations") > 0)
