"""Operators against brute force, properties and the SQL twins."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siftwire.operators import augment as A
from siftwire.operators import classifiers as G
from siftwire.operators import evaluate as J
from siftwire.operators import event_metrics as M
from siftwire.operators import explain as E
from siftwire.operators import features as X
from siftwire.operators import ingest as I
from siftwire.operators import log_analytics as Q
from siftwire.operators import scoring as S
from siftwire.sources import corpus as SC

MESSAGES = [
    (1, "claim your free prize now", 1), (2, "free cash prize claim today", 1), (3, "urgent verify bank account", 1),
    (4, "lunch tomorrow with the team", 0), (5, "meeting notes from yesterday", 0), (6, "see you at lunch tomorrow", 0),
    (7, "notes for the team meeting", 0), (8, "call mom after lunch", 0),
]


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(MESSAGES, "doc_id bigint, final_text string, label_encoded int").withColumn(
        "text", F.col("final_text")
    )


def test_readers(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes("ham\tcafé ok\nspam\t\"NA\nodd\tx\n".encode("latin-1"))
    rows = {tuple(r) for r in SC.read_labelled_tsv(spark, str(tmp_path / "a.tsv"), quote=None).collect()}
    assert rows == {("café ok", "ham", 0), ('"NA', "spam", 1)}
    (tmp_path / "b.csv").write_text('body,kind\n"a ""q"", b",spam\n,ham\n')
    rows = SC.read_labelled_csv(spark, str(tmp_path / "b.csv"), "body", "kind").collect()
    assert [(r["text"], r["label_encoded"]) for r in rows] == [('a "q", b', 1)]
    with pytest.raises(ValueError):
        SC.read_labelled_csv(spark, str(tmp_path / "b.csv"), "nope", "kind")
    with pytest.raises(FileNotFoundError):
        SC.load_processed(spark, str(tmp_path), "missing")


def test_checksums(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    row = SC.file_checksums(spark, str(tmp_path)).first()
    assert row["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_split_is_a_partition_with_equal_shares(spark):
    df = spark.range(1003).select(F.col("id").alias("doc_id"), (F.col("id") % 7 == 0).cast("int").alias("label_encoded"))
    a = I.stratified_split(df).collect()
    b = I.stratified_split(df.repartition(7)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 1003
    for part, share in (("test", 0.2), ("val", 0.1), ("train", 0.7)):
        for label in (0, 1):
            n = sum(r["label_encoded"] == label for r in a)
            got = sum(r["label_encoded"] == label and r["split"] == part for r in a)
            assert abs(got - share * n) <= 1.5
    assert sum(r["split"] == "test" for r in a) == math.ceil(0.2 * 1003)


def test_dedupe_keeps_the_first(spark):
    df = spark.createDataFrame([(3, "x", 1), (1, "x", 0), (2, "y", 1)], "doc_id int, text string, label_encoded int")
    assert {tuple(r) for r in I.dedupe_text(df).collect()} == {(1, "x", 0), (2, "y", 1)}


def test_tfidf_by_hand(spark, labelled):
    options = X.TfidfOptions(min_df=1, max_df=1.0)
    counts = X.term_counts(labelled, "final_text", options=options)
    vocabulary = X.fit_tfidf(labelled, "final_text", options=options)
    rows = X.tfidf(counts, vocabulary, options=options).collect()
    norms = {}
    for r in rows:
        norms[r["doc_id"]] = norms.get(r["doc_id"], 0.0) + r["tfidf"] ** 2
    assert len(norms) == 8 and all(n == pytest.approx(1.0) for n in norms.values())
    lunch = vocabulary.filter("term = 'lunch'").first()
    assert lunch["df"] == 3 and lunch["idf"] == pytest.approx(math.log(9 / 4) + 1)
    assert [r["term"] for r in X.feature_names(vocabulary).collect()] == sorted({r["term"] for r in rows})
    with pytest.raises(RuntimeError):
        X.weigh(counts, None)


def test_vectorizer_and_models_survive_storage(spark, labelled, tmp_path):
    options = X.TfidfOptions(min_df=1, max_df=1.0, strip_accents=False)
    vocabulary = X.fit_tfidf(labelled, "final_text", options=options)
    SC.save_vectorizer(vocabulary, options, str(tmp_path), "v")
    back, stored = SC.load_vectorizer(spark, str(tmp_path), "v")
    assert stored == options and back.count() == vocabulary.count()
    counts = X.term_counts(labelled, "final_text", options=options, keep=("label_encoded",), outer=True)
    vectors = X.tfidf_vectors(counts, back, keep=("label_encoded",), options=options).cache()
    fitted, failures = G.train_all(vectors, ("naive_bayes", "logistic_regression", "svm"))
    assert not failures
    for model in fitted:
        G.save_classifier(model, str(tmp_path / "models"), spark)
        again = G.load_classifier(model.name, str(tmp_path / "models"), spark)
        a = {r["doc_id"]: r["spam_probability"] for r in model.score(vectors).collect()}
        b = {r["doc_id"]: r["spam_probability"] for r in again.score(vectors).collect()}
        assert a == b and len(a) == 8
    names = [r["model_name"] for r in SC.model_registry(spark, str(tmp_path / "models")).collect()]
    assert names == ["logistic_regression", "naive_bayes", "svm"]
    with pytest.raises(ValueError):
        G.settings("other")
    with pytest.raises(FileNotFoundError):
        G.load_classifier("absent", str(tmp_path), spark)


def test_bayes_scores_unknown_text_by_prior(spark, labelled):
    model = G.fit_naive_bayes(labelled, options=X.TfidfOptions(min_df=1, max_df=1.0, strip_accents=False))
    texts = spark.createDataFrame([(1, "zzz"), (2, "free prize claim"), (3, "")], "doc_id bigint, final_text string")
    got = {r["doc_id"]: r["spam_probability"] for r in G.score_naive_bayes(model, texts).collect()}
    assert got[1] == pytest.approx(3 / 8) and got[3] == pytest.approx(3 / 8) and got[2] > 0.5


def test_explanations(spark, labelled):
    model = G.fit_naive_bayes(labelled, options=X.TfidfOptions(min_df=1, max_df=1.0, strip_accents=False))
    predict = E.predictor(S.naive_bayes_scorer(model))
    items = spark.createDataFrame([(1, "Free prize, lunch tomorrow!"), (2, "")], "doc_id bigint, text string")
    shap = {r["doc_id"]: r for r in E.explain(items, predict, "shap", max_evals=60).collect()}
    ends = spark.createDataFrame([("a", "Free prize, lunch tomorrow!"), ("b", ", !")], "row_key string, text string")
    p = {r["row_key"]: r["spam_probability"] for r in predict(ends, "row_key", ()).collect()}
    assert sum(w["score"] for w in shap[1]["word_importances"]) == pytest.approx(p["a"] - p["b"])
    assert shap[1]["confidence"] == pytest.approx(max(p["a"], 1 - p["a"]))
    assert shap[2]["prediction"] == "error" and shap[2]["confidence"] == 0.0
    lime = {r["doc_id"]: r for r in E.explain(items, predict, "lime", num_samples=40).collect()}
    assert set(lime[1]["top_spam_words"]) == {"Free", "prize"} and set(lime[1]["top_ham_words"]) == {"lunch", "tomorrow"}
    with pytest.raises(ValueError):
        E.explain(items, predict, "other")


def test_auc_is_the_pair_count(spark):
    rng = random.Random(1)
    rows = [("m", rng.randint(0, 1), rng.choice([0.0, 1.0, 0.5, rng.random(), 1 - 1e-12])) for _ in range(300)]
    pos = [s for _, y, s in rows if y]
    neg = [s for _, y, s in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows + [("one", 1, 0.3)], "model string, y int, score double")
    got = {r["model"]: r["roc_auc"] for r in J.roc_auc(df).collect()}
    assert got["m"] == pytest.approx(want) and got["one"] == 0.0


def brute_rate(events, limit, width):
    recent, out = {}, {}
    for at, event, client in sorted((a, e, c) for c, e, a in events):
        kept = [t for t in recent.get(client, []) if at - t < width]
        out[event] = len(kept) < limit
        recent[client] = kept + [at] if out[event] else kept
    return out


@pytest.mark.parametrize("limit", [1, 3, 5])
def test_rate_limit_matches_brute_force(spark, limit):
    rng = random.Random(limit)
    events, at = [], 0
    for e in range(1500):
        at += rng.choice([0, 1, 2, 5, 30, 90]) if e % 200 < 150 else rng.choice([1, 2])
        events.append((1 if rng.random() < 0.6 else rng.randint(2, 5), e, at))
    df = spark.createDataFrame(events, "client bigint, event_id bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: r["admitted"] for r in M.rate_limit(df, limit, 60).collect()}
    assert got == brute_rate(events, limit, 60)


def test_augmentation_is_stable_and_bounded(spark, labelled):
    synonyms = spark.createDataFrame([("free", "gratis"), ("prize", "award")], "word string, synonym string")
    rows = labelled.select("doc_id", "text", "label_encoded")
    a = sorted(map(tuple, A.augment_minority(rows.repartition(1), synonyms).collect()))
    b = sorted(map(tuple, A.augment_minority(rows.repartition(8), synonyms).collect()))
    assert a == b
    made = [r for r in a if r[3]]
    assert 0 < len(made) <= 9 and all(r[2] == 1 for r in made)
    swapped = A.random_swap(rows, seed=7).join(rows.withColumnRenamed("text", "old"), "doc_id").collect()
    assert all(sorted(r["text"].split()) == sorted(r["old"].split()) and r["text"] != r["old"] for r in swapped)
    kept = A.random_delete(rows, p=1.0).collect()
    assert all(len(r["text"].split()) == 1 for r in kept)
    assert A.synonym_replace(rows.filter("doc_id = 1"), synonyms).first()["text"] == "claim your gratis award now"
    with pytest.raises(ValueError):
        A.AugmentOptions(techniques=("other",))


def test_validation(spark):
    df = spark.createDataFrame(
        [("", 0.5, "spam", None), ("x" * 10001, 2.0, "odd", "c" * 1001), ("ok", 1.0, "ham", "c")],
        "text string, threshold double, correct_label string, comment string",
    )
    got = [r["violations"] for r in Q.validate_requests(df).collect()]
    assert got == [["text_too_short"], ["text_too_long", "threshold_range", "label_unknown", "comment_too_long"], []]


def test_feedback_status(spark):
    batch = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 99)], "id int, prediction_id int")
    log = spark.createDataFrame([(10,), (11,)], "id int")
    old = spark.createDataFrame([(11,)], "prediction_id int")
    got = {r["id"]: r["status"] for r in Q.feedback_ingest(batch, log, old).collect()}
    assert got == {1: "accepted", 2: "duplicate", 3: "duplicate", 4: "not_found"}


def test_threshold_and_confidence(spark):
    df = spark.createDataFrame([(0.4,)], "p double")
    assert df.select(S.decide(F.col("p"), 0.3).alias("d")).first()["d"] == "spam"


def test_any_model_can_score(spark):
    def load():
        import numpy as np

        return lambda texts: np.array([[0.0, 5.0 if "free" in t else -5.0] for t in texts])

    rows = spark.createDataFrame([(1, "free"), (2, "lunch")], "doc_id bigint, text string")
    scored = S.Scorers({"any": lambda: S.batch_scorer(load)}, "any").score(rows, raw_text=True)
    assert {r["doc_id"]: r["prediction"] for r in scored.collect()} == {1: "spam", 2: "ham"}
    with pytest.raises(FileNotFoundError):
        S.Scorers({}).get("absent")


@pytest.mark.parametrize("name", ["timeline", "dedupe_text", "roc_auc", "clean_text", "feedback_ingest", "metrics_stream", "rate_limit_stream"])
def test_sql_twins(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    from siftwire.plans.catalog import QUERIES
    from siftwire.plans.oracles import ORACLES

    con = duckdb.connect()
    for table in ("documents", "labels", "events", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    want = sorted(map(repr, con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()))
    assert got == want
