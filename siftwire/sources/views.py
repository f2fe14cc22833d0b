"""Views of plain tables in the shapes the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled texts: doc_id, text, label, label_encoded."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label_encoded"))
    label = F.when(F.col("label_encoded") == 1, "spam").when(F.col("label_encoded") == 0, "ham")
    return docs.join(labels, "doc_id").select("doc_id", "text", label.alias("label"), "label_encoded")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def chat_messages(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")


def prediction_log(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("value") / (F.col("value") + 50)
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        F.when(p >= 0.5, "spam").otherwise("ham").alias("prediction"),
        F.greatest(p, 1 - p).alias("confidence"),
        p.alias("spam_probability"),
        F.col("event_type").alias("model_used"),
        F.col("value").alias("processing_time_ms"),
        F.col("ts").alias("created_at"),
    )


def feedback_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Submitted feedback: every tenth prediction, some twice, some for unknown predictions."""
    base = prediction_log(spark, folder).filter(F.col("id") % 10 == 0)
    label = F.when(F.col("id") % 3 == 0, "spam").otherwise("ham").alias("correct_label")

    def rows(keep, shift, unknown):
        return base.filter(keep).select(
            (F.col("id") + shift).alias("id"),
            (F.col("id") + unknown).alias("prediction_id"),
            "user_id",
            label,
            "created_at",
        )

    return (
        rows(F.lit(True), 0, 0)
        .unionByName(rows(F.col("id") % 20 == 0, 2_000_000_000, 0))
        .unionByName(rows(F.col("id") % 50 == 0, 3_000_000_000, 1_000_000_000))
    )


def feedback_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Feedback given earlier: every thirtieth prediction."""
    return (
        prediction_log(spark, folder)
        .filter(F.col("id") % 30 == 0)
        .select(
            (F.col("id") + 5_000_000_000).alias("id"),
            F.col("id").alias("prediction_id"),
            "user_id",
            F.when(F.col("id") % 3 == 0, "spam").otherwise("ham").alias("correct_label"),
            "created_at",
        )
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.select(
        "event_id",
        F.col("user_id").alias("client"),
        "ts",
        F.when(F.col("event_id") % 4 == 0, "POST").otherwise("GET").alias("method"),
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (F.col("value") / 1000).alias("duration"),
    )


def scored_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions with a true label: model, y, yhat, score."""
    log = prediction_log(spark, folder)
    return log.select(
        F.col("model_used").alias("model"),
        (F.col("user_id") % 3 == 0).cast("int").alias("y"),
        (F.col("prediction") == "spam").cast("int").alias("yhat"),
        F.col("spam_probability").alias("score"),
    )
