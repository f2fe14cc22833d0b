"""Streaming twins of the batch operators: the same expressions on arriving rows, and nothing that arrives late is lost.

Every job writes each micro-batch to a folder named by stream and batch number; Spark's own mark of a
finished job is the commit record. A repeated batch finds its folder finished, or overwrites what a failed
attempt left. State that goes from batch to batch is such a folder, too.
"""

from __future__ import annotations

import json
import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwire.operators import event_metrics as M
from siftwire.operators.scoring import Scorer, measured, score_messages, to_log
from siftwire.session import drop_folder, finished_parts
from siftwire.sources import corpus as SC


def read_stream(
    spark: SparkSession, path: str, schema, max_files: int | None = None, glob: str | None = None
) -> DataFrame:
    """Files of a folder as a stream; ``glob`` narrows it to some file names."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _each_batch(stream: DataFrame, checkpoint: str, store, trigger: dict | None):
    """Run ``store(batch, stream id, batch number)`` for every micro-batch; the id belongs to the checkpoint."""

    @cache
    def stream_id() -> str:
        return json.loads(stream.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, number: store(batch, stream_id(), number))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _numbers(spark: SparkSession, path: str, kind: str, stream: str) -> list[int]:
    """Batches of a stream whose folder of this kind is finished."""
    start = f"{kind}={stream}-"
    return sorted(int(name[len(start) :]) for name in finished_parts(spark, path, start))


def _parts(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """What all streams have finished of a kind."""
    names = finished_parts(spark, path, f"{kind}=")
    if not names:
        if schema is None:
            raise FileNotFoundError(f"nothing finished under {path}")
        return spark.createDataFrame([], schema)
    return spark.read.parquet(*(f"{path}/{n}" for n in names))


# ---- scores ----------------------------------------------------------------------------------


def score_stream(
    messages: DataFrame,
    scorer: Scorer,
    model_name: str,
    path: str,
    checkpoint: str,
    created_at: Column | None = None,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    trigger: dict | None = None,
):
    """Score arriving messages into the prediction log, once each, whatever is repeated.

    The log is the one that batch jobs write, and ``read_predictions`` reads it. A message is told by id, text
    and model: a repeated batch, and a new checkpoint over the same messages, add nothing. The time of
    a batch's scoring, spread over its rows, goes with them.
    """
    stamp = F.current_timestamp() if created_at is None else created_at

    def store(batch: DataFrame, stream: str, number: int) -> None:
        scored = measured(score_messages(batch, scorer, model_name, threshold, id_col=id_col))
        SC.append_predictions(to_log(scored, batch, stamp, "api", id_col), path, f"{stream}-{number}")

    return _each_batch(messages, checkpoint, store, trigger)


# ---- metrics ---------------------------------------------------------------------------------

#: Batches after which the folders of a stream's metrics are joined into one.
JOIN_EVERY = 16


def windowed_metrics(
    events: DataFrame, keys: tuple[str, ...], value: str, bounds, ts: str = "ts", width: str = "15 seconds"
) -> DataFrame:
    """Count, sum and cumulative buckets per key and tumbling window. Events without a time are in no window."""
    v = F.col(value)
    return (
        events.withColumn("event_time", F.col(ts).cast("timestamp"))
        .groupBy(F.window("event_time", width).alias("w"), *keys)
        .agg(F.count(v).alias("n"), F.sum(v).alias("total_sum"), *M.bucket_counts(v, bounds))
        .withColumn("window_start", F.col("w.start"))
        .drop("w")
    )


def _merged(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    group = ("window_start", *keys)
    return parts.groupBy(*group).agg(*(F.sum(c).alias(c) for c in parts.columns if c not in group))


def metrics_stream(
    events: DataFrame, keys: tuple[str, ...], value: str, bounds, path: str, checkpoint: str,
    ts: str = "ts", width: str = "15 seconds", join_every: int = JOIN_EVERY, trigger: dict | None = None,
):
    """Keep windowed metrics up to date; read them back with ``latest_metrics``.

    What a batch adds to its windows is stored, and adding up is left to the reader: no state is held, no window
    ever closes, and an event counts however late it comes. Every ``join_every`` batches the folders
    become one, so reading costs windows and a few batches, not the age of the stream; folders that were joined
    are removed one joining later, when no reader that started before should need them.
    """

    def store(batch: DataFrame, stream: str, number: int) -> None:
        spark = batch.sparkSession
        joined = _numbers(spark, path, "joined", stream)
        if joined and joined[-1] >= number:
            return
        if number not in _numbers(spark, path, "part", stream):
            windowed_metrics(batch, keys, value, bounds, ts, width).write.mode("overwrite").parquet(f"{path}/part={stream}-{number}")
        if (number + 1) % join_every == 0:
            live = spark.read.parquet(*_live(spark, path, stream))
            _merged(live, keys).write.mode("overwrite").parquet(f"{path}/joined={stream}-{number}")
            for kind in ("part", "joined"):
                for old in _numbers(spark, path, kind, stream):
                    if joined and old <= joined[-1] and (kind, old) != ("joined", joined[-1]):
                        drop_folder(spark, f"{path}/{kind}={stream}-{old}")

    return _each_batch(events, checkpoint, store, trigger)


def _live(spark: SparkSession, path: str, stream: str) -> list[str]:
    """Folders that together hold a stream's metrics: the last joined one and the parts after it."""
    joined = _numbers(spark, path, "joined", stream)
    last = joined[-1] if joined else -1
    parts = [n for n in _numbers(spark, path, "part", stream) if n > last]
    return [f"{path}/joined={stream}-{last}"] * bool(joined) + [f"{path}/part={stream}-{n}" for n in parts]


def latest_metrics(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """Every window and key with all that has arrived for it, from all streams that write here."""
    names = finished_parts(spark, path, "part=") + finished_parts(spark, path, "joined=")
    streams = {re.sub(r"^[a-z]+=(.*)-[0-9]+$", r"\1", n) for n in names}
    folders = [f for stream in sorted(streams) for f in _live(spark, path, stream)]
    if not folders:
        raise FileNotFoundError(f"no metrics under {path}")
    return _merged(spark.read.parquet(*folders), keys)


# ---- rate limit --------------------------------------------------------------------------------

#: Windows behind the newest request for which decisions stay possible.
KEEP_WINDOWS = 10


def rate_limit_stream(
    requests: DataFrame, path: str, checkpoint: str, limit: int = 60, window_seconds: int = 60,
    client: str = "client", event: str = "event_id", ts: str = "ts", keep_windows: int = KEEP_WINDOWS, trigger: dict | None = None,
):
    """Admit or reject arriving requests; ``read_decisions`` has a row for every one.

    A micro-batch is decided by the batch operator, with what earlier batches admitted as history. A request
    that comes up to ``keep_windows`` windows after newer ones is decided by the history as it stands. What comes
    later still cannot be: such requests are stored as late, without a decision, and counted. The
    history is the admitted requests of so many windows, a table and not a task's memory; the newest
    two of them are kept.
    """
    keep = keep_windows * window_seconds * 1_000_000

    def store(batch: DataFrame, stream: str, number: int) -> None:
        spark = batch.sparkSession
        done = _numbers(spark, path, "told", stream)
        if number in done:
            return
        before = [n for n in done if n < number]
        rows = batch.select(F.col(client).alias("client"), F.col(event).alias("event_id"), F.col(ts).cast("timestamp").alias("ts"))
        at = M.epoch_micros(F.col("ts"))
        kinds = dict(rows.dtypes)
        if before:
            newest = spark.read.parquet(f"{path}/told={stream}-{before[-1]}").first().newest
            history = spark.read.parquet(f"{path}/history={stream}-{before[-1]}")
        else:
            newest = None
            history = spark.createDataFrame([], f"client {kinds['client']}, at bigint")
        is_late = F.lit(False) if newest is None else F.coalesce(at < newest - keep, F.lit(False))

        def write(df: DataFrame, kind: str) -> DataFrame:
            target = f"{path}/{kind}={stream}-{number}"
            df.write.mode("overwrite").parquet(target)
            return spark.read.schema(df.schema).parquet(target)

        late = write(rows.filter(is_late).select("client", "event_id", at.alias("at")), "late")
        decided = M.rate_limit(rows.filter(~is_late), limit, window_seconds, admitted_before=history)
        decided = write(decided, "decided")
        told = decided.agg(F.max("at").alias("newest"), F.count("*").alias("n")).first()
        newest = max((x for x in (newest, told.newest) if x is not None), default=None)
        admitted = history.unionByName(decided.filter("admitted").select("client", "at"))
        write(admitted if newest is None else admitted.filter(F.col("at") >= newest - keep), "history")
        write(spark.createDataFrame([(newest, told.n, late.count())], "newest bigint, decided bigint, late bigint"), "told")
        for old in _numbers(spark, path, "history", stream):
            if before and old < before[-1]:
                drop_folder(spark, f"{path}/history={stream}-{old}")

    return _each_batch(requests, checkpoint, store, trigger)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """One row for every request: client, event_id, at, admitted, remaining, and ``late`` where nothing could be decided."""
    decided = _parts(spark, path, "decided").withColumn("late", F.lit(False))
    late = _parts(spark, path, "late").withColumn("late", F.lit(True))
    return decided.unionByName(late, allowMissingColumns=True)


def late_counts(spark: SparkSession, path: str) -> DataFrame:
    """Requests decided and late, over all batches."""
    return _parts(spark, path, "told").agg(F.sum("decided").alias("decided"), F.sum("late").alias("late"))
