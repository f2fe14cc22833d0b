import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwire.operators import evaluate as J
from siftwire.operators import explain as E
from siftwire.operators import log_analytics as Q
from siftwire.operators import scoring as S


def test_models_without_scores_stay_on_the_leaderboard(spark):
    rows = [("a", 1, 1, None), ("a", 0, 0, None), ("a", 0, 1, None), ("b", 1, 1, 0.9), ("b", 0, 0, 0.2), ("c", 1, None, None)]
    df = spark.createDataFrame(rows, "model string, y int, yhat int, score double")
    area = {r.model: r.roc_auc for r in J.roc_auc(df).collect()}
    assert area == {"a": 0.75, "b": 1.0, "c": 0.0}
    assert {r.model for r in J.model_leaderboard(df).collect()} == {"a", "b", "c"}


def test_equal_ids_are_scored_apart(spark):
    df = spark.createDataFrame([(1, "free prize"), (1, "lunch notes"), (1, "lunch notes")], "doc_id long, text string")

    def scorer(texts, id_col, keep):
        spam = F.max(F.col("final_text").contains("prize").cast("double")).alias("spam_probability")
        return texts.groupBy(id_col, *keep).agg(spam).withColumn("ham_probability", 1 - F.col("spam_probability"))

    for scored in (S.score_messages(df, scorer, "m"), S.score_batch(df, scorer, "m")):
        assert sorted(r.prediction for r in scored.collect()) == ["ham", "spam"]


def test_a_page_above_the_limit_is_refused(spark):
    log = spark.createDataFrame([(i, 7, i) for i in range(300)], "id long, user_id long, created_at long")
    assert Q.history(log, 7, 200).count() == 200
    with pytest.raises(ValueError, match="at most 200"):
        Q.history(log, 7, 500)
    assert Q.history(log, 7, 250, largest_page=250).count() == 250


def test_rows_without_a_user_and_repeated_feedback(spark):
    log = spark.createDataFrame([(1, None), (2, 5), (3, 6)], "id long, user_id long")
    kept = Q.clear_missing_users(log, spark.createDataFrame([(5,)], "id long"))
    assert sorted(tuple(r) for r in kept.select("id", F.coalesce("user_id", F.lit(-1))).collect()) == [(1, -1), (2, 5), (3, -1)]
    batch = spark.createDataFrame([(10, 2), (11, 2), (12, 99), (13, None), (14, 99)], "id long, prediction_id long")
    none = spark.createDataFrame([], "prediction_id long")
    status = {r.id: r.status for r in Q.feedback_ingest(batch, log, none).collect()}
    assert status == {10: "accepted", 11: "duplicate", 12: "not_found", 13: "not_found", 14: "not_found"}


def test_many_words_fit_in_samples(spark):
    """More words than samples: the fit works in samples, and gives what the plain normal equations give."""
    rng = np.random.default_rng(0)
    words, n = [f"w{i}" for i in range(60)], 40
    rows = [{"sample": i, "gone_at": rng.choice(60, rng.integers(1, 30), replace=False).tolist() if i else [], "p": float(rng.random())} for i in range(n)]
    import pandas as pd

    batch = pd.DataFrame([("k", 0.5, 0.5, words, rows)], columns=["key", "spam_probability", "ham_probability", "words", "rows"])
    fitted = next(iter(E._linear_fit(60)([batch])))["fitted"][0]
    x = np.ones((n, 60))
    for r in rows:
        x[r["sample"], r["gone_at"]] = 0
    w = np.sqrt(np.exp(-(((1 - np.sqrt(x.mean(1))) * 100) ** 2) / E.KERNEL_WIDTH**2))
    y = np.array([r["p"] for r in rows])
    xc, yc = x - (w @ x) / w.sum(), y - (w * y).sum() / w.sum()
    want = np.linalg.solve((xc * w[:, None]).T @ xc + np.eye(60), (xc * w[:, None]).T @ yc)
    got = {c["word"]: c["score"] for c in fitted}
    assert np.allclose([got[v] for v in words], want)
