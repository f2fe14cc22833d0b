import itertools
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from siftwire.llm import toxicity as T

WORDS = [f"word{i}" for i in range(200)]
BAD = ["nasty", "vile", "rotten"]


def make(n, seed, start=0):
    rng, rows = random.Random(seed), []
    for i in range(start, start + n):
        bad = rng.random() < 0.3
        words = rng.choices(WORDS, k=rng.randrange(5, 60))
        if bad:
            words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "s", "er"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_features():
    lexicon = T.Lexicon({b"vile": 3.0, b"nast*": 2.0})
    named = dict(zip(T.FEATURES, T.features("YOU are a NASTYish v1le thing!! soooo", lexicon), strict=True))
    assert named["strongest"] == 2.0 and named["hit_density"] == pytest.approx(1 / 7)
    assert named["second_person_near"] > 0 and named["marks"] > 0 and named["letter_runs"] > 0 and named["capital_runs"] > 0
    assert named["obfuscated"] > 0 and named["obfuscated_hits"] > 0
    assert T.features(None, lexicon) == T.features("", lexicon) == T.features(" .,", lexicon) == [0.0] * len(T.FEATURES)


@pytest.fixture(scope="module")
def scored(spark):
    rows = make(700, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, None), (9001, "", ""), (9002, "w " * 50_000, "")], "doc_id long, text string, score string")
    labels = [(i, y) for i, _, y in rows] + [(3, 1), (None, 1), (9001, 7), (9002, None)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    return rows, docs, labels, T.toxicity_digest(docs, labels).collect()


def test_held_out_accuracy(scored):
    rows, docs, _, out = scored
    assert len(out) == len(rows) + 3
    truth = {i: y for i, _, y in rows}
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_held_out_labels_are_not_used(scored, spark):
    rows, docs, labels, out = scored
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in T.toxicity_digest(docs, flipped).collect()}
    assert again == {r.doc_id: r.score for r in out}


def test_filter_and_few_labels(scored, spark):
    rows, docs, labels, out = scored
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in out)
    none = T.fit(docs, labels.limit(0), F.lit(True)).score(docs)
    assert {r.score for r in none.collect()} == {0.0}
    one_class = T.fit(docs, labels.filter("toxic = 1"), F.lit(True)).score(docs.limit(3))
    assert {r.score for r in one_class.collect()} == {1.0}
    assert T.toxicity_digest(docs.limit(0), labels).count() == 0


def plain_lexicon(rows, certain):
    """Entry -> weight, from (text, label) pairs."""
    counts = ({}, {})
    for text, label in rows:
        words = set(T.words_of(text))
        for entry in words | {w[:k] + b"*" for w in words for k in (4, 5, 6) if len(w) >= k}:
            counts[label][entry] = counts[label].get(entry, 0) + 1
    totals = [sum(y == k for _, y in rows) for k in (0, 1)]
    out = {}
    for entry, toxic in counts[1].items():
        clean = counts[0].get(entry, 0)
        weight = math.log((toxic + 0.5) / (totals[1] + 1)) - math.log((clean + 0.5) / (totals[0] + 1))
        if toxic >= max(3, totals[1] // 500) and weight > math.log(4) and weight >= certain * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)):
            out[entry] = weight
    return out


@pytest.mark.parametrize("certain", [0.5, 3.0])
def test_lexicon_equals_brute_force(spark, certain):
    rows = [(t, y) for _, t, y in make(500, 3)] + [("", 0), (None, 1), ("nastyish vileness " * 3, 1)]
    got = T.mine_lexicon(spark.createDataFrame(rows, "text string, label int").repartition(5), certain)
    assert got == pytest.approx(plain_lexicon(rows, certain)) and b"nast*" in got


def plain_isotonic(points):
    """Pool adjacent violators over (x, y), rows of equal x together: (x, level) in order."""
    pools = []
    for x, ys in itertools.groupby(sorted(points), key=lambda p: p[0]):
        ys = [y for _, y in ys]
        pools.append([sum(ys), len(ys), [x]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            top = pools.pop()
            pools[-1] = [pools[-1][0] + top[0], pools[-1][1] + top[1], pools[-1][2] + top[2]]
    return {x: s / n for s, n, xs in pools for x in xs}


def test_calibration_equals_pooled_violators(spark):
    """Scores of the rows that calibrate are the pooled shares of toxic rows among equal or neighbouring margins."""
    rows = make(600, 9)
    rng = random.Random(2)
    rows = [(i, t, y if rng.random() < 0.9 else 1 - y) for i, t, y in rows]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = T.fit(docs, labels, F.lit(True))
    held = docs.join(labels, "doc_id").filter(F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(4)) == 0)
    with_margin = T.rows_with_raw(model.trees, T._with_features(held, model.lexicon, "text", "__features").withColumn("__features", T.array_to_vector("__features")))
    points = {r.doc_id: (r["__raw"], r.toxic) for r in with_margin.select("doc_id", "__raw", "toxic").collect()}
    want = plain_isotonic(points.values())
    got = {r.doc_id: r.score for r in model.score(held.select("doc_id", "text")).collect()}
    assert len(points) > 100 and all(got[i] == pytest.approx(want[x]) for i, (x, _) in points.items())
