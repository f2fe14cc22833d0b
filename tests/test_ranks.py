import random

from siftwire.operators import augment as A
from siftwire.operators.ranks import ranked


def test_ranks(spark):
    rows = [(random.Random(i).randrange(90), i) for i in range(500)] + [(None, 501), (None, 502)]
    frame = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = sorted((r.rank, r.k) for r in ranked(frame, ["k"]).collect())
    assert [g[0] for g in got] == list(range(502))
    assert [g[1] for g in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert ranked(frame.limit(0), ["k"]).count() == 0


def test_draws_have_no_cap(spark):
    n = 2100  # with the factor of 3 more than any cap there was
    rows = spark.range(n).selectExpr("id as doc_id", "concat('text ', id) as text")
    drawn = A.draw_rows(rows, 3, None, 42)
    counts = [r["count"] for r in drawn.groupBy("doc_id").count().collect()]
    assert sum(counts) == 3 * n and drawn.select("draw_no").distinct().count() == 3 * n
    assert len(counts) / n > 0.93 and max(counts) < 15  # 1 - e^-3 of the rows are drawn at all
    assert A.draw_rows(rows, 3, 100, 42).count() == 100 and A.draw_rows(rows.limit(0), 3, None, 42).count() == 0
    assert sorted(drawn.collect()) == sorted(A.draw_rows(rows.repartition(5), 3, None, 42).collect())


def test_minority_grows_threefold(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "concat('alpha beta gamma delta word', id) as text", "cast(id % 3 = 0 as int) as label_encoded")
    options = A.AugmentOptions(techniques=("random_swap",))
    out = A.augment_minority(rows, None, options)
    assert out.filter("not synthetic").count() == 3000
    made = out.filter("synthetic").count()
    assert 2500 < made <= 3000  # all but the draws whose swap changes nothing
    assert A.augment_minority(rows, None, A.AugmentOptions(techniques=("random_swap",), max_samples=10)).filter("synthetic").count() <= 10
