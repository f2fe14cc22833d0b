"""Counters, histograms, gauges and rate limits over event tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwire.session import stored

# Upper bucket bounds.
LATENCY_MS = (5, 10, 25, 50, 100, 250, 500, 1000)
CONFIDENCE = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)
REQUEST_SECONDS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
LOAD_SECONDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def counter(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def prediction_counts(log: DataFrame) -> DataFrame:
    return counter(log, "model_used", "prediction")


def request_counts(requests: DataFrame) -> DataFrame:
    return counter(requests, "method", "endpoint", "status")


def bucket_counts(value: Column, bounds) -> list[Column]:
    """One cumulative count per bound, for use in an aggregate."""
    return [F.count_if(value <= F.lit(float(b))).alias(f"le_{i}") for i, b in enumerate(bounds)]


def stack_buckets(aggregated: DataFrame, keys, bounds) -> DataFrame:
    """Turn the counts of one row into one row per bucket."""
    labels = [format(b, "g") for b in bounds] + ["+Inf"]
    cells = [
        F.struct(F.lit(label).alias("le"), F.col(f"le_{i}" if i < len(bounds) else "n").alias("cumulative"))
        for i, label in enumerate(labels)
    ]
    return aggregated.select(
        *keys, F.explode(F.array(*cells)).alias("cell"), "total_sum", F.col("n").alias("total_count")
    ).select(*keys, "cell.le", "cell.cumulative", "total_count", "total_sum")


def histogram(df: DataFrame, value: str, bounds, *keys: str) -> DataFrame:
    """Cumulative buckets with total count and sum per key, in one aggregate."""
    v = F.col(value)
    rows = df.groupBy(*keys).agg(
        *bucket_counts(v, bounds), F.count(v).alias("n"), F.sum(v).alias("total_sum")
    )
    return stack_buckets(rows, keys, bounds)


def latency_histogram(log: DataFrame) -> DataFrame:
    return histogram(log, "processing_time_ms", LATENCY_MS, "model_used")


def confidence_histogram(log: DataFrame) -> DataFrame:
    return histogram(log, "confidence", CONFIDENCE, "model_used", "prediction")


def request_duration_histogram(requests: DataFrame) -> DataFrame:
    return histogram(requests, "duration", REQUEST_SECONDS, "method", "endpoint")


def model_load_histogram(loads: DataFrame) -> DataFrame:
    return histogram(loads, "load_seconds", LOAD_SECONDS, "model_used")


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def in_flight_gauge(requests: DataFrame, window_seconds: int = 3600) -> DataFrame:
    """Requests in progress at the end of every window that saw a start or a finish.

    Starts and ends collapse to one net change per window before anything is ordered. The running
    sum has two levels: windows are dealt out by ranges, each range sums up its own, and what the
    ranges before it add up to, one number a range, comes on top. Requests without a time are left out;
    one without a duration ends where it starts.
    """
    width = window_seconds * 1_000_000
    start = epoch_micros(F.col("ts"))
    end = start + F.coalesce(F.round(F.col("duration") * 1_000_000).cast("bigint"), F.lit(0))
    changes = requests.filter(F.col("ts").isNotNull()).select(
        F.explode(
            F.array(
                F.struct(start.alias("at"), F.lit(1).alias("change")),
                F.struct(end.alias("at"), F.lit(-1).alias("change")),
            )
        ).alias("c")
    ).select(F.floor(F.col("c.at") / F.lit(width)).cast("bigint").alias("slot"), "c.change")
    net = changes.groupBy("slot").agg(F.sum("change").alias("net_change"))
    ranged = stored(net.repartitionByRange("slot").withColumn("range", F.spark_partition_id()), "net-changes")
    sums = ranged.groupBy("range").agg(F.sum("net_change").alias("total"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carried = sums.select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("carried"))
    own = F.sum("net_change").over(Window.partitionBy("range").orderBy("slot"))
    summed = ranged.withColumn("own", own).join(F.broadcast(carried), "range")
    return summed.select(
        (F.col("slot") * window_seconds).alias("window_start"), "net_change", (F.col("own") + F.col("carried")).alias("in_flight")
    )


def rate_limit(
    requests: DataFrame,
    limit: int = 60,
    window_seconds: int = 60,
    client: str = "client",
    event: str = "event_id",
    ts: str = "ts",
    admitted_before: DataFrame | None = None,
) -> DataFrame:
    """Admit or reject every request: fewer than ``limit`` admitted in the trailing window.

    Rejected requests do not count, so a decision depends on earlier ones. The history of a
    client is still cut exactly: time falls into slots of one window; where two neighbouring
    slots hold no more than ``limit`` requests together, everything in the later slot is
    admitted, without a look at single requests. The other slots are decided in time order, in runs
    between such places, each preceded by the slot before it. The counts behind the cuts
    are one row per client and slot. What is left, a client above its limit without a pause,
    is read as a stream with a state of ``limit`` numbers.

    ``admitted_before`` (client, at) are requests that were admitted by an earlier job; they count,
    but are not decided again. Requests without a client are those of one client without a name;
    a request without a time cannot be placed and is rejected.
    """
    width = window_seconds * 1_000_000
    rows = requests.select(
        F.col(client).alias("client"), F.col(event).alias("event_id"), epoch_micros(F.col(ts)).alias("at"), F.lit(False).alias("before")
    )
    kinds = dict(rows.dtypes)
    nameless = rows.filter(F.col("at").isNull()).select(
        "client", "event_id", "at", F.lit(False).alias("admitted"), F.lit(0).alias("remaining")
    )
    rows = rows.filter(F.col("at").isNotNull())
    if admitted_before is not None:
        known = admitted_before.select("client", F.lit(None).cast(kinds["event_id"]).alias("event_id"), "at", F.lit(True).alias("before"))
        rows = rows.unionByName(known)
    # A name of its own for the client without one, which joins and windows then treat like any other.
    rows = rows.withColumn("who", F.struct("client")).withColumn("slot", F.floor(F.col("at") / F.lit(width)).cast("bigint"))

    slots = rows.groupBy("who", "slot").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("who").orderBy("slot")
    gap = F.col("slot") - F.lag("slot", 1).over(order)
    near = F.when(gap == 1, F.lag("n", 1).over(order)).otherwise(F.lit(0))
    calm = slots.withColumn("near", near).withColumn("calm", F.col("near") + F.col("n") <= limit)
    # A run starts at a calm slot after a calm or empty one; the slot before it is its history.
    was_calm = F.when(F.col("near") == 0, F.lit(True)).otherwise(F.coalesce(F.lag("calm", 1).over(order), F.lit(True)))
    starts = calm.withColumn("starts", (F.col("calm") & was_calm) | (F.col("near") == 0))
    runs = (
        starts.withColumn("run", F.max(F.when(F.col("starts"), F.col("slot"))).over(order))
        .withColumn("busy", F.max((~F.col("calm")).cast("int")).over(Window.partitionBy("who", "run")) == 1)
        .withColumn("next_run", F.lead("run", 1).over(order))
        .withColumn("next_busy", F.lead("busy", 1).over(order))
        .withColumn("next_slot", F.lead("slot", 1).over(order))
    )
    # The last slot of a run is copied to the next run, if that one directly follows.
    follows = (F.col("next_run") != F.col("run")) & (F.col("next_slot") == F.col("slot") + 1)
    own = F.struct("run", F.lit(False).alias("seed"), "busy")
    seed = F.when(follows, F.struct(F.col("next_run").alias("run"), F.lit(True).alias("seed"), F.col("next_busy").alias("busy")))
    targets = runs.select("who", "slot", F.explode(F.array_compact(F.array(own, seed))).alias("t")).select("who", "slot", "t.*")
    placed = stored(rows.join(targets, ["who", "slot"]), "placed-requests")
    kept = ["client", "event_id", "at", "admitted", "remaining"]
    schema = f"client {kinds['client']}, event_id {kinds['event_id']}, at bigint, admitted boolean, remaining int"
    busy = placed.filter("busy").repartition("who", "run").sortWithinPartitions("who", "run", "at", F.desc("before"), "event_id")
    scanned = busy.select("client", "run", "event_id", "at", "seed", "before").mapInPandas(_rate_scan(limit, width), schema)
    # A calm run: every request is admitted, so those of the trailing window are counted.
    run = Window.partitionBy("who", "run")
    trailing = F.count(F.lit(1)).over(run.orderBy("at").rangeBetween(1 - width, 0))
    peers = Window.partitionBy("who", "run", "at")
    later = F.count(F.lit(1)).over(peers) - F.row_number().over(peers.orderBy(F.desc("before"), "event_id"))
    calm = placed.filter("not busy").withColumn("recent", trailing - later).filter("not seed and not before")
    calm = calm.select("client", "event_id", "at", F.lit(True).alias("admitted"), (F.lit(limit) - F.col("recent")).cast("int").alias("remaining"))
    return scanned.select(kept).unionByName(calm).unionByName(nameless.select(kept))


def _rate_scan(limit: int, width: int):
    """Decides sorted requests one after the other; the state is the admitted times of the trailing window."""

    def scan(batches: Iterator) -> Iterator:
        from collections import deque

        import pandas as pd

        group, recent = None, deque()
        for batch in batches:
            out = []
            for client, run, event, at, seed, before in zip(
                *(batch[c] for c in ("client", "run", "event_id", "at", "seed", "before")), strict=True
            ):
                own = (None if pd.isna(client) else client, run)
                if own != group:
                    group, recent = own, deque()
                while recent and at - recent[0] >= width:
                    recent.popleft()
                admitted = before or len(recent) < limit
                if admitted:
                    recent.append(at)
                if not seed and not before:
                    left = limit - len(recent) if admitted else 0
                    out.append((own[0], event, at, admitted, max(left, 0)))
            yield pd.DataFrame(out, columns=["client", "event_id", "at", "admitted", "remaining"])

    return scan
