import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siftwire.operators import event_metrics as M
from siftwire.operators import scoring as S
from siftwire.sources import corpus as SC
from siftwire.streaming import jobs as ST

START = dt.datetime(2024, 1, 1)
REQUESTS = "client string, event_id long, ts timestamp_ntz, endpoint string, duration double"


def plain_rate_limit(rows, limit, window):
    """rows: (client, event, seconds); event -> (admitted, remaining), decided one after the other."""
    recent, out = {}, {}
    for client, event, at in sorted(rows, key=lambda r: (r[2], r[1])):
        own = recent.setdefault(client, [])
        own[:] = [t for t in own if at - t < window]
        admitted = len(own) < limit
        if admitted:
            own.append(at)
        out[event] = (admitted, limit - len(own) if admitted else 0)
    return out


def made_requests(n, seed, clients=("a", "b", None), span=3000):
    rng = random.Random(seed)
    rows, at = [], 0.0
    for i in range(n):
        at += rng.choice([0, 1, 1, 5, 40, 200]) if rng.random() < 0.3 else 1
        rows.append((rng.choice(clients), i, at))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(c, e, None if at is None else START + dt.timedelta(seconds=at), "x", 0.1) for c, e, at in rows], REQUESTS)


@pytest.mark.parametrize("limit,window", [(3, 20), (10, 20), (1, 7)])
def test_rate_limit_equals_one_by_one(spark, limit, window):
    rows = made_requests(500, limit)
    got = M.rate_limit(frame(spark, rows + [("a", 900, None)]), limit, window).collect()
    assert {r.event_id: (r.admitted, r.remaining) for r in got} == plain_rate_limit(rows, limit, window) | {900: (False, 0)}
    assert len(got) == 501 and {r.client for r in got} == {"a", "b", None}


def test_history_counts(spark):
    rows = made_requests(300, 4)
    first, rest = rows[:140], rows[140:]
    before = M.rate_limit(frame(spark, first), 4, 30)
    after = M.rate_limit(frame(spark, rest), 4, 30, admitted_before=before.filter("admitted").select("client", "at"))
    got = {r.event_id: (r.admitted, r.remaining) for r in after.collect()}
    want = plain_rate_limit(rows, 4, 30)
    assert got == {e: want[e] for _, e, _ in rest}


def stream_in(spark, folder, files, number):
    for rows in files:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/in{number}")
    return ST.read_stream(spark, f"{folder}/in{number}", REQUESTS, max_files=1)


def test_rate_limit_stream_has_a_row_for_every_request(spark, tmp_path):
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    rows = made_requests(240, 9)
    late = [("a", 1000 + i, 5.0 + i) for i in range(7)]
    behind = [("b", 2000 + i, rows[-1][2] - 15 - i) for i in range(4)]
    files = [rows[:80], rows[80:160], rows[160:], late + behind]
    for i, own in enumerate(files):  # one after the other, with a restart between them
        stream = stream_in(spark, str(tmp_path), [own], 0)
        ST.rate_limit_stream(stream, path, checkpoint, 4, 30, keep_windows=3).awaitTermination()
    got = ST.read_decisions(spark, path).collect()
    assert sorted(r.event_id for r in got) == sorted(e for own in files for _, e, _ in own)
    want = plain_rate_limit(rows, 4, 30)
    assert {r.event_id: (r.admitted, r.remaining) for r in got if r.event_id < 1000} == want
    assert {r.event_id for r in got if r.late} == {e for _, e, _ in late}
    assert all(r.admitted is None for r in got if r.late) and all(r.admitted is not None for r in got if not r.late)
    assert tuple(ST.late_counts(spark, path).first()) == (len(got) - 7, 7)


def test_metrics_stream_counts_late_events_and_joins_folders(spark, tmp_path):
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    rows = made_requests(200, 3)
    random.Random(1).shuffle(rows)
    for i in range(0, 200, 25):
        stream = stream_in(spark, str(tmp_path), [rows[i : i + 25]], 0)
        ST.metrics_stream(stream, ("endpoint",), "duration", (0.05, 1.0), path, checkpoint, join_every=3).awaitTermination()
    whole = ST.windowed_metrics(frame(spark, rows), ("endpoint",), "duration", (0.05, 1.0))
    got = ST.latest_metrics(spark, path, ("endpoint",))
    columns = ["window_start", "endpoint", "n", "le_0", "le_1"]
    assert sorted(got.select(columns).collect()) == sorted(whole.select(columns).collect())
    assert got.agg(F.sum("n")).first()[0] == 200
    kinds = [p.name.split("=")[0] for p in (tmp_path / "out").iterdir()]
    assert kinds.count("joined") == 2 and kinds.count("part") < 8


def plain_scorer(texts, id_col, keep):
    spam = F.when(F.col("final_text").contains("win"), 0.9).otherwise(0.2)
    return texts.select(id_col, *keep, (1 - spam).alias("ham_probability"), spam.alias("spam_probability"))


MESSAGES = [(1, "you win now"), (2, "see you later"), (2, "another text of this id"), (1, "you win now"), (None, "win without an id"), (4, None), (5, "")]


def test_log_has_one_row_for_each_message(spark):
    messages = spark.createDataFrame(MESSAGES, "doc_id long, text string")
    for scored in (S.score_messages(messages, plain_scorer, "m"), S.score_batch(messages, plain_scorer, "m")):
        log = S.to_log(S.measured(scored), messages, F.lit(START), "api").collect()
        assert sorted((r.id or "", r.input_text or "") for r in log) == sorted({("" if i is None else str(i), t or "") for i, t in MESSAGES})
        assert all((r.prediction == "spam") == ("win" in (r.input_text or "")) for r in log)
        assert all(r.processing_time_ms > 0 for r in log)
    other = messages.withColumnRenamed("text", "body")
    assert S.to_log(S.score_batch(other, plain_scorer, "m", text_col="body"), other, F.lit(START), "batch", text_col="body").count() == 6


def test_scores_reach_one_log_once(spark, tmp_path):
    path = str(tmp_path / "log")
    messages = spark.createDataFrame(MESSAGES, "doc_id long, text string")
    messages.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: ST.read_stream(spark, str(tmp_path / "in"), messages.schema)
    run = lambda check, at: ST.score_stream(stream(), plain_scorer, "m", path, str(tmp_path / check), F.lit(at)).awaitTermination()
    run("check", START)
    first = sorted(map(str, SC.read_predictions(spark, path).collect()))
    assert len(first) == 6
    run("check", START)
    run("other", START + dt.timedelta(days=3))  # a new checkpoint reads all of it again
    assert sorted(map(str, SC.read_predictions(spark, path).collect())) == first
    more = spark.createDataFrame([(1, "you win now"), (9, "fresh")], messages.schema)
    S_log = S.to_log(S.score_batch(more, plain_scorer, "m"), more, F.lit(START + dt.timedelta(days=1)), "batch")
    SC.append_predictions(S_log, path, "day-2")
    SC.append_predictions(S_log, path, "day-2")
    log = SC.read_predictions(spark, path)
    assert log.count() == 7 and SC.read_predictions(spark, path, F.lit(START + dt.timedelta(days=1)).cast("date")).count() == 1
    (tmp_path / "log" / "part=day-2" / "_SUCCESS").unlink()  # as if the writer had failed
    assert SC.read_predictions(spark, path).count() == 6
    SC.append_predictions(S_log, path, "day-2")
    assert SC.read_predictions(spark, path).count() == 7


def test_explanations_never_cost_a_score(spark):
    messages = spark.createDataFrame(MESSAGES, "doc_id long, text string")

    def explain(rows, text_col, key):
        cells = F.array(F.struct(F.lit("win").alias("word"), F.lit(0.5).alias("score"), F.lit(True).alias("is_spam_indicator")))
        wrong = F.when(F.col(text_col).contains("later"), "error").otherwise("spam")
        return rows.select(key, F.lit("lime").alias("method"), wrong.alias("prediction"), cells.alias("word_importances"))

    def broken(rows, text_col, key):
        return explain(rows, text_col, key).withColumn("method", F.raise_error(F.lit("no explanation today")).cast("string"))

    plain = S.score_messages(messages, plain_scorer, "m")
    good = S.score_messages(messages, plain_scorer, "m", explain=explain)
    bad = S.score_messages(messages, plain_scorer, "m", explain=broken)
    for out in (good, bad):
        assert sorted(map(str, out.drop("explanation").collect())) == sorted(map(str, plain.collect()))
    assert bad.filter("explanation is not null").count() == 0
    assert {r.doc_id for r in good.filter("explanation is null").collect()} == {2} and good.filter("explanation is null").count() == 1


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_gauge_equals_one_window(spark, parts):
    rng = random.Random(2)
    rows = [(None, i, rng.uniform(0, 400_000)) for i in range(600)]
    requests = frame(spark, rows + [("z", 999, None)]).withColumn("duration", F.when(F.col("event_id") % 50 != 0, F.col("event_id") * 37.0))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.window_start: (r.net_change, r.in_flight) for r in M.in_flight_gauge(requests).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    base, change = START.replace(tzinfo=dt.timezone.utc).timestamp(), {}
    for _, i, at in rows:
        at = round(at, 6)
        end = at + (i * 37.0 if i % 50 else 0)
        for t, d in ((at, 1), (end, -1)):
            slot = int((base + t) // 3600) * 3600
            change[slot] = change.get(slot, 0) + d
    total, want = 0, {}
    for slot in sorted(change):
        total += change[slot]
        want[slot] = (change[slot], total)
    assert got == want and total == 0
