"""Character noise in batches: the same draws as one by one, every letter's other case as Spark has it."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from siftwire.functions.draws import draws_along, uniform
from siftwire.operators import augment as A


def test_draws_along_equal_digests_one_by_one():
    stems = [b"42:char:7:0", b"", b"42:char:" + b"x" * 60, b"y" * 50, b"y" * 51, b"y" * 52, b"42:char:123456789012:3"]
    counts = np.array([1200, 11, 30, 120, 12, 3, 0])
    hand = [int(hashlib.md5(s + b":%d" % i).hexdigest()[:8], 16) for s, n in zip(stems, counts) for i in range(n)]
    assert draws_along(stems, counts).tolist() == hand and draws_along([], np.array([], dtype=int)).tolist() == []


def one_by_one(rows, p, seed=42):
    """Noise as an expression on every character."""
    def noisy(c, i):
        u = uniform(seed, "char", F.col("doc_id"), F.col("turn"), i) / F.lit(p)
        other = F.when(F.upper(c) == c, F.lower(c)).otherwise(F.upper(c))
        return F.when(u >= 1, c).when(u * 3 < 1, F.when(c.rlike(r"\p{L}"), other).otherwise(c)).when(u * 3 < 2, F.concat(c, c)).otherwise("")

    chars = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?s)."), F.lit(0))
    return rows.withColumn("text", F.array_join(F.transform(chars, noisy), ""))


def test_noise_equals_the_expression_on_every_character(spark, monkeypatch):
    odd = ["", None, "a", "Straße GROẞ ŉ ǅ İı ΑΣ ς ﬁ", "日本語 😀 text\nwith\tlines", "é" * 300, "plain words, many of them " * 200, "x" * 20_000]
    letters = "".join(chr(c) for c in range(0xC0, 0x590) if chr(c).isalpha())
    rows = [(i, i % 3, t) for i, t in enumerate([*odd, *[letters] * 40])] + [(None, 0, "no id " * 50), (7, 0, "the id of another " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, turn int, text string").coalesce(1)
    for p in (0.05, 0.9):
        got = A.char_noise(df, p, draw_col="turn")
        assert got.columns == df.columns and got.collect() == one_by_one(df, p).collect()


def test_noise_hashes_many_characters_at_a_time(spark):
    """No digest expression is left for each character."""
    plan = A.char_noise(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "md5" not in plan and "ArrowEvalPython" in plan and "Exchange" not in plan
