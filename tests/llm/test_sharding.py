import pytest
from pyspark.sql import functions as F

from siftwire.llm import sharding

SCHEMA = "doc_id long, text string, size string, __x int"


def shards_of(rows, n):
    out = sharding.histogram_shards(rows, shards=n)
    return [r.asDict() for r in out.collect()]


def check_slots(rows):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


@pytest.mark.parametrize("piece", [64 << 20, 20_000])
def test_bytes_are_near_equal(spark, small, piece):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [r.asDict() for r in sharding.histogram_shards(docs, shards=4, piece_bytes=piece).collect()]
    assert len(rows) == docs.count()
    assert all(r["size"] == len((r["text"] or "").encode()) + 16 for r in rows)
    check_slots(rows)
    sums = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(4)]
    largest = max(r["size"] for r in rows)
    assert max(sums) - min(sums) <= 2 * largest


def test_hot_group_is_split_and_others_stay_together(spark):
    rows = [(i, "same text", "x", 1) for i in range(300)] + [(1000 + i, f"text {i // 2}", "y", 2) for i in range(600)]
    out = shards_of(spark.createDataFrame(rows, SCHEMA), 6)
    check_slots(out)
    counts = [sum(r["shard"] == s for r in out) for s in range(6)]
    assert max(counts) <= 1.1 * min(counts) + 2
    pairs = {}
    for r in out:
        if r["text"] != "same text":
            pairs.setdefault(r["text"], set()).add(r["shard"])
    assert sum(len(x) > 1 for x in pairs.values()) <= 5


def test_rows_without_id_that_repeat_one_text(spark):
    rows = spark.createDataFrame([(None, "all the same", "x", 1)] * 1000 + [(i, f"other {i}", "x", 1) for i in range(200)], SCHEMA)
    out = sharding.histogram_shards(rows.repartition(3), shards=40, piece_bytes=500).collect()
    out = [r.asDict() for r in out]
    check_slots(out)
    sums = [sum(r["size"] for r in out if r["shard"] == s) for s in range(40)]
    assert len(out) == 1200 and max(sums) - min(sums) <= 2 * max(r["size"] for r in out)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, None, None, None), (1, "", "s", 3), (1, "", "s", 3), (2, "long " * 5000, None, 1)]
    out = shards_of(spark.createDataFrame(rows, SCHEMA), 3)
    check_slots(out)
    assert sorted(r["size"] for r in out) == [16, 16, 16, 25016]
    assert {"__x", "doc_id", "text", "size", "shard", "slot"} == set(out[0])
    assert shards_of(spark.createDataFrame([], SCHEMA), 3) == []
    assert {r["shard"] for r in shards_of(spark.createDataFrame(rows, SCHEMA), 1)} == {0}


def test_digest(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = sharding.shard_digest(docs)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    wrong = out.join(docs, "doc_id").filter(F.col("text_crc32") != F.crc32(F.coalesce("text", F.lit(""))))
    assert out.count() == docs.count() and wrong.count() == 0
