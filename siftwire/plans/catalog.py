"""One query per operator over the given tables; see ``oracles`` for the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwire.functions import cleaning as C
from siftwire.functions import profile as R
from siftwire.functions import tokens as K
from siftwire.operators import augment as A
from siftwire.operators import classifiers as G
from siftwire.operators import evaluate as J
from siftwire.operators import event_metrics as M
from siftwire.operators import explain as E
from siftwire.operators import features as X
from siftwire.operators import ingest as I
from siftwire.operators import lexicon as L
from siftwire.operators import log_analytics as Q
from siftwire.operators import scoring as S
from siftwire.plans import training as T
from siftwire.plans.preprocess import preprocess, preprocess_to_text
from siftwire.session import is_file, scratch_path, stored
from siftwire.sources import corpus as SC
from siftwire.sources import views as V
from siftwire.streaming import jobs as ST

AS_OF = "2024-01-31 00:00:00"
USER = 8
SYNONYMS = [
    ("that", "which"), ("that", "what"), ("with", "alongside"), ("from", "out of"), ("this", "such"),
    ("they", "people"), ("have", "own"), ("pour", "afin"), ("nicht", "kaum"), ("para", "hacia"),
    ("the", "that"), ("is", "be"), ("of", "from"), ("et", "puis"), ("und", "sowie"),
]
RATE_LIMIT, RATE_WINDOW = 2, 6 * 3600


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so engines that add in another order agree."""
    return df.select(*[r6(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def joined(name: str, mark: str = "|"):
    return F.array_join(name, mark).alias(name)


def synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYNONYMS, "word string, synonym string")


# ---- sources and ingest ---------------------------------------------------------------


def read_labelled_tsv(spark, d):
    path = scratch_path(spark, "tsv")
    rows = V.corpus(spark, d).select("label", F.regexp_replace("text", r"\s+", " ").alias("text"))
    rows.write.option("sep", "\t").option("quote", "").csv(path)
    return SC.read_labelled_tsv(spark, path, quote=None, encoding="UTF-8")


def read_labelled_csv(spark, d):
    path = scratch_path(spark, "csv")
    rows = V.corpus(spark, d).select(F.col("text").alias("body"), F.col("label_encoded").alias("class"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    df = SC.read_labelled_csv(spark, path, "body", "class", numeric_labels=True, multi_line=True)
    return df.select("text", "label_encoded")


def encode_label(spark, d):
    return I.encode_label(V.corpus(spark, d).drop("label_encoded")).select("doc_id", "label_encoded")


def _with_unknown(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    labels = V.table(spark, d, "labels").select("doc_id", F.col("toxic"))
    name = F.when(F.col("toxic") == 1, "spam").when(F.col("toxic") == 0, "ham").otherwise("unknown")
    return I.encode_label(docs.join(labels, "doc_id", "left").select("doc_id", "text", name.alias("label")))


def drop_unknown_labels(spark, d):
    return I.drop_unknown_labels(_with_unknown(spark, d), "text").select("doc_id", "label", "label_encoded")


def unknown_label_counts(spark, d):
    return I.unknown_label_counts(_with_unknown(spark, d))


def dedupe_text(spark, d):
    return I.dedupe_text(V.corpus(spark, d)).select("doc_id", "label_encoded", F.md5("text").alias("text_md5"))


def corpus_stats(spark, d):
    return rounded(I.corpus_stats(I.dedupe_text(V.corpus(spark, d))))


def stratified_split(spark, d):
    return I.stratified_split(V.corpus(spark, d)).select("doc_id", "label_encoded", "split")


def random_split(spark, d):
    return I.stratified_split(V.corpus(spark, d), stratify=False).select("doc_id", "split")


def split_summary(spark, d):
    return rounded(I.split_summary(I.stratified_split(V.corpus(spark, d))))


def processed_roundtrip(spark, d):
    root = scratch_path(spark, "processed")
    SC.save_processed(V.corpus(spark, d), root, "corpus")
    back = SC.load_processed(spark, root, "corpus")
    return back.select("doc_id", "label", "label_encoded", F.md5("text").alias("text_md5"))


def file_checksums(spark, d):
    return SC.file_checksums(spark, d, "*.parquet").select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", "sha256"
    )


def file_checksums_written(spark, d):
    """Checksums of files that the query writes, one for each language: a line for each document."""
    path = scratch_path(spark, "files")
    line = F.concat_ws(" ", "doc_id", F.octet_length("text")).alias("line")
    rows = V.table(spark, d, "documents").select("lang", "doc_id", line)
    rows.repartition("lang").sortWithinPartitions("lang", "doc_id").drop("doc_id").write.partitionBy("lang").text(path)
    longer = {"whole_bytes": 2000, "piece_bytes": 777}  # so that both ways are taken
    return SC.file_checksums(spark, path, "part-*", **longer).select(F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang"), "length", "sha256")


def append_predictions(spark, d):
    path = scratch_path(spark, "log")
    log = V.prediction_log(spark, d)
    SC.append_predictions(log.filter(F.col("id") % 2 == 0).withColumn("source", F.lit("api")), path)
    SC.append_predictions(log.filter(F.col("id") % 2 == 1).withColumn("source", F.lit("batch")), path)
    SC.append_predictions(log.filter(F.col("id") % 3 == 0).withColumn("source", F.lit("again")), path)  # adds nothing
    return rounded(
        SC.read_predictions(spark, path).select(
            F.col("id").cast("bigint").alias("id"), F.col("created_date").cast("string").alias("day"), "source", "user_id",
            "prediction", "confidence", "spam_probability", "ham_probability", "model_used", "processing_time_ms",
        )
    )


def _results(spark, d):
    rows = V.scored_rows(spark, d)
    return (
        J.classification_metrics(rows)
        .drop("n")
        .join(J.roc_auc(rows), "model")
        .join(J.confusion_array(rows), "model")
        .withColumnRenamed("model", "model_name")
    )


def benchmark_store(spark, d):
    path = scratch_path(spark, "benchmark")
    SC.save_benchmark(_results(spark, d), path)
    return rounded(SC.load_benchmark(spark, path))


def model_registry(spark, d):
    root = scratch_path(spark, "models")
    G.save_naive_bayes(G.fit_naive_bayes(_final_corpus(spark, d)), root)
    rows, _ = _vectors(spark, d)
    G.save_classifier(G.fit_classifier("logistic_regression", _part(rows, "train")), root, spark)
    return SC.model_registry(spark, root)


# ---- cleaning --------------------------------------------------------------------------


def _step(function, column="text", source=V.messages, key="doc_id"):
    def query(spark, d):
        return source(spark, d).select(key, function(F.col(column)).alias("result"))

    return query


def _html(spark, d):
    return V.table(spark, d, "pages").select("page_id", "html")


def clean_text(spark, d):
    return C.clean_text(V.messages(spark, d)).select("doc_id", "cleaned_text")


def clean_chat(spark, d):
    options = C.CleanOptions(lowercase=False, mask_numbers=False, drop_special=False, min_length=40)
    return C.clean_text(V.chat_messages(spark, d), options=options).select("doc_id", "cleaned_text")


# ---- tokens ----------------------------------------------------------------------------


def _token_query(function, backend="regex"):
    def query(spark, d):
        df = C.clean_text(V.messages(spark, d))
        df = df.withColumn("tokens", K.tokenize(F.col("cleaned_text"), backend))
        return df.select("doc_id", F.array_join(function(F.col("tokens")), "|").alias("tokens"))

    return query


def detokenize(spark, d):
    df = V.messages(spark, d)
    return df.select("doc_id", K.detokenize(K.tokenize_regex(F.col("text"))).alias("text"))


def tokenize_whitespace(spark, d):
    return V.messages(spark, d).select(
        "doc_id", F.array_join(K.tokenize_whitespace(F.col("text")), "|").alias("tokens")
    )


def _normalized(spark, d):
    df = C.clean_text(V.messages(spark, d))
    return df.withColumn("tokens", K.normalize_tokens(K.tokenize_regex(F.col("cleaned_text"))))


def spam_keywords(spark, d):
    return _normalized(spark, d).select("doc_id", F.array_join(K.spam_keywords(F.col("tokens")), "|").alias("keywords"))


def spam_keyword_count(spark, d):
    return _normalized(spark, d).select("doc_id", K.spam_keyword_count(F.col("tokens")).alias("n"))


def lemmatize(spark, d):
    """Every token of the messages, by the library's lexicon and irregular forms."""
    tokens = F.transform(K.tokenize_regex(F.col("text")), F.lower).alias("tokens")
    rows = stored(V.messages(spark, d).select("doc_id", tokens), "tokens")
    forms = rows.select(F.explode_outer("tokens").alias("form")).filter("form is not null").distinct()
    return L.lemmatize(rows, L.default_lemmas(forms)).select("doc_id", joined("tokens"))


def tokenize_by_name(spark, d):
    rows = V.messages(spark, d)
    parts = [rows.select("doc_id", F.lit(name).alias("name"), joined_tokens(K.tokenize(F.col("text"), name.upper()))) for name in K.TOKENIZERS]
    return parts[0].unionByName(parts[1])


def joined_tokens(tokens):
    return F.array_join(tokens, "|").alias("tokens")


def stem_vocabulary(spark, d):
    rows = stored(_normalized(spark, d).select("doc_id", "tokens"), "tokens")
    return L.stem(rows).select("doc_id", joined("tokens"))


# ---- row features ----------------------------------------------------------------------


def _columns(columns):
    def query(spark, d):
        text = F.col("text")
        return rounded(V.messages(spark, d).select("doc_id", *[c.alias(k) for k, c in columns(text).items()]))

    return query


def text_lengths(spark, d):
    return preprocess(V.messages(spark, d)).select("doc_id", "original_length", "cleaned_length", "token_count")


def preprocess_query(spark, d):
    return rounded(
        preprocess(V.messages(spark, d)).select(
            "doc_id", "cleaned_text", "final_text", joined("spam_keywords"), "original_length",
            "cleaned_length", "token_count", "spam_keyword_count", "has_url", "has_email", "has_phone",
            "has_currency", "uppercase_ratio", "digit_ratio", "special_char_ratio",
        )
    )


# ---- features --------------------------------------------------------------------------


def _final_corpus(spark, d):
    return preprocess_to_text(V.corpus(spark, d), keep=("label_encoded",))


def ngram_terms(spark, d):
    return X.term_counts(V.messages(spark, d))


def char_ngram_terms(spark, d):
    options = X.TfidfOptions(analyzer="char", ngrams=(2, 3))
    return X.document_frequency(X.term_counts(V.messages(spark, d), options=options))


def document_frequency(spark, d):
    return X.document_frequency(X.term_counts(_final_corpus(spark, d), "final_text", options=X.CLEANED))


def _vocabulary(spark, d, options=X.CLEANED):
    return X.fit_tfidf(_final_corpus(spark, d), "final_text", options=options)


def select_vocabulary(spark, d):
    options = X.TfidfOptions(max_features=2000, min_df=3, max_df=0.5, strip_accents=False)
    return _vocabulary(spark, d, options).select("term", "idx", "df", "corpus_tf")


def idf(spark, d):
    return rounded(_vocabulary(spark, d).select("term", "idf"))


def tfidf(spark, d):
    texts = stored(_final_corpus(spark, d), "texts")  # read by the vocabulary and the weights
    counts = X.term_counts(texts, "final_text", options=X.CLEANED, packed=True)
    return rounded(X.tfidf(counts, X.fit_tfidf(texts, "final_text", options=X.CLEANED)).select("doc_id", "term", "tf", "tfidf"))


def feature_names(spark, d):
    return X.feature_names(_vocabulary(spark, d))


def vocabulary_size(spark, d):
    return X.vocabulary_size(_vocabulary(spark, d))


def top_idf_terms(spark, d):
    return rounded(X.top_idf_terms(_vocabulary(spark, d), 20))


def save_load_vectorizer(spark, d):
    root = scratch_path(spark, "vectorizer")
    SC.save_vectorizer(_vocabulary(spark, d), X.TfidfOptions(), root, "tfidf_spam")
    vocabulary, _ = SC.load_vectorizer(spark, root, "tfidf_spam")
    return rounded(vocabulary.select("term", "idx", "idf"))


def build_vocab(spark, d):
    return X.build_vocab(_final_corpus(spark, d), "final_text")


def texts_to_sequences(spark, d):
    vocab = X.build_vocab(_final_corpus(spark, d), "final_text")
    coded = X.texts_to_sequences(preprocess_to_text(V.messages(spark, d)), vocab, "final_text")
    return coded.select("doc_id", F.array_join(F.col("sequence").cast("array<string>"), " ").alias("sequence"))


# ---- classifiers and scoring -----------------------------------------------------------


def _bayes(spark, d):
    """Fit, store and read back, as scoring jobs do."""
    root = scratch_path(spark, "models")
    G.save_naive_bayes(G.fit_naive_bayes(_final_corpus(spark, d)), root)
    return G.load_naive_bayes(spark, root)


def naive_bayes(spark, d):
    return rounded(G.fit_naive_bayes(_final_corpus(spark, d)).terms.select("term", "ham_logp", "spam_logp"))


def balanced_weights(spark, d):
    return rounded(G.balanced_weights(V.corpus(spark, d)).select("doc_id", "label_encoded", "weight"))


def score_messages(spark, d):
    scorer = S.naive_bayes_scorer(_bayes(spark, d))
    scored = S.score_messages(V.messages(spark, d), scorer, "naive_bayes")
    return rounded(
        scored.select(
            "doc_id", "prediction", "confidence", "spam_probability", "ham_probability", "model_used",
            "metadata.original_length", "metadata.token_count", "metadata.spam_keyword_count",
            "metadata.has_url", "metadata.uppercase_ratio",
        )
    )


def score_batch(spark, d):
    scorer = S.naive_bayes_scorer(_bayes(spark, d))
    scored = S.score_batch(V.chat_messages(spark, d), scorer, "naive_bayes", threshold=0.3)
    return rounded(scored.select("doc_id", "prediction", "confidence", "spam_probability", "source"))


def scored_log_summary(spark, d):
    """Messages scored with their time, logged and summed up: the log knows what scoring took."""
    path, chats = scratch_path(spark, "log"), V.chat_messages(spark, d)
    scored = S.measured(S.score_messages(chats, S.naive_bayes_scorer(_bayes(spark, d)), "naive_bayes"))
    SC.append_predictions(S.to_log(scored, chats, F.lit(AS_OF).cast("timestamp"), "api"), path)
    told = Q.summary(SC.read_predictions(spark, path), F.lit("2024-01-31 12:00:00").cast("timestamp"), G.MODEL_NAMES)
    return told.select("total_predictions", "predictions_today", (F.col("avg_processing_time_ms") > 0).alias("timed"))


def explain_errors(spark, d):
    """Local explanations by a model that fails on some texts: those are error rows, the others are explained."""

    def load():
        def model(texts):
            if any(t.startswith("A") for t in texts):
                raise RuntimeError("this text is too much")
            return [[float(len(t)), 0.0] for t in texts]

        return model

    done = E.explain(V.table(spark, d, "benchmark"), lambda rows, key, keep: S.batch_scorer(load)(rows, key, keep), "lime", id_col="item_id", num_samples=20)
    return done.select("item_id", (F.col("prediction") == "error").alias("failed"), (F.size("word_importances") > 0).alias("explained"))


def score_by_model(spark, d):
    scorers = S.Scorers({"naive_bayes": lambda: S.naive_bayes_scorer(_bayes(spark, d))}, "naive_bayes")
    scored = scorers.score(V.chat_messages(spark, d), "naive_bayes")
    return scored.groupBy("model_used", "prediction").agg(F.count(F.lit(1)).alias("n"))


def score_two_models(spark, d):
    def logistic():
        rows, vocabulary = _vectors(spark, d)
        return S.classifier_scorer(G.fit_classifier("logistic_regression", _part(rows, "train")), vocabulary)

    scorers = S.Scorers({"naive_bayes": lambda: S.naive_bayes_scorer(_bayes(spark, d)), "logistic_regression": logistic})
    chats = V.chat_messages(spark, d)
    both = scorers.score(chats, "naive_bayes").unionByName(scorers.score(chats))  # the second by the default
    larger = F.abs(F.col("confidence") - F.greatest("spam_probability", "ham_probability")) < 1e-12
    follows = (F.col("prediction") == "spam") == (F.col("spam_probability") >= 0.5)
    return both.select("doc_id", "model_used", (larger & follows).alias("consistent"))


def proba_argmax(spark, d):
    vectors = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("logits"))
    top = S.proba_argmax(vectors, "logits")
    return rounded(top.select("vec_id", "label", F.array_max("proba").alias("top_proba")))


def score_stream(spark, d):
    path, checkpoint = scratch_path(spark, "scored"), scratch_path(spark, "checkpoint")
    turns = _table_stream(spark, d, "conversations")
    arriving = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    scorer = S.naive_bayes_scorer(_bayes(spark, d))
    ST.score_stream(
        arriving, scorer, "naive_bayes", path, checkpoint, F.lit(AS_OF).cast("timestamp")
    ).awaitTermination()
    log = SC.read_predictions(spark, path, F.to_date(F.lit(AS_OF)))
    return rounded(
        log.select("id", "prediction", "spam_probability", "model_used", "text_length", "spam_keyword_count", "source")
    )


def validate_requests(spark, d):
    rows = V.table(spark, d, "documents").select("doc_id", "text", "source", (F.col("doc_id") % 7 / 5).alias("threshold"))
    checked = Q.validate_requests(rows, "source")
    return checked.select("doc_id", joined("violations"))


# ---- explanation -----------------------------------------------------------------------


def _explained(method, **kwargs):
    def query(spark, d):
        predict = E.predictor(S.naive_bayes_scorer(_bayes(spark, d)))
        items = V.table(spark, d, "benchmark")
        done = E.explain(items, predict, method, id_col="item_id", **kwargs)
        return done.select("item_id", "prediction", "confidence", "method", F.explode("word_importances").alias("w")).select(
            "item_id", "prediction", "confidence", "method", "w.word", "w.score", "w.is_spam_indicator"
        )

    return query


# ---- Spark ML classifiers --------------------------------------------------------------


def _vectors(spark, d):
    """Train, validation and test vectors on the split corpus, and the vocabulary behind them."""
    rows = I.stratified_split(V.corpus(spark, d))
    texts = stored(preprocess_to_text(rows, keep=("label_encoded", "split")), "texts")
    counts = X.term_counts(texts, "final_text", options=X.CLEANED, keep=("label_encoded", "split"), outer=True, packed=True)
    train = texts.filter(F.col("split") == "train")
    # Every fit reads both many times: store them once where all executors can find them.
    vocabulary = stored(X.fit_tfidf(train, "final_text", options=X.CLEANED), "vocabulary")
    return stored(X.tfidf_vectors(counts, vocabulary, keep=("label_encoded", "split")), "vectors"), vocabulary


def _part(rows, name):
    return rows.filter(F.col("split") == name)


def _classifier(name, **overrides):
    def query(spark, d):
        rows, _ = _vectors(spark, d)
        held = _part(rows, "val") if name in ("xgboost", "lightgbm") else None
        fitted = G.fit_classifier(name, _part(rows, "train"), held, **overrides)
        return _checked(fitted.score(rows))

    return query


def _checked(scored):
    """Scored rows as facts that must hold: a share of one, the larger side wins, the training rows of both classes are learned.

    A constant model finds none of one class, so each class is looked at on its own.
    """
    kept = ("doc_id", "split", "label_encoded", "ham_probability", "spam_probability", "predicted")
    scored = stored(scored.select(*kept), "scored")
    right = F.avg((F.col("predicted") == F.col("label_encoded")).cast("int"))
    recall = scored.filter(F.col("split") == "train").groupBy("label_encoded").agg(right.alias("share"))
    learned = recall.agg((F.min("share") > 0.6).alias("learned")).scalar()
    ham, spam = F.col("ham_probability"), F.col("spam_probability")
    return scored.select(
        "doc_id",
        "split",
        "label_encoded",
        ((F.abs(ham + spam - 1) < 1e-9) & ham.between(0, 1) & spam.between(0, 1)).alias("adds_up"),
        ((spam == ham) | ((spam > ham) == (F.col("predicted") == 1))).alias("larger_wins"),
        learned.alias("learned"),
    )


def feature_importance(spark, d):
    rows, vocabulary = _vectors(spark, d)
    fitted = G.fit_classifier("logistic_regression", _part(rows, "train"))
    return G.feature_importance(fitted, vocabulary, 20)


def train_all(spark, d):
    rows, _ = _vectors(spark, d)
    root = scratch_path(spark, "trained")
    outcome, board = T.train_evaluate_store(rows, root)
    cards = SC.model_registry(spark, root).select("model_name")
    stored = cards.join(SC.load_benchmark(spark, f"{root}/benchmark").select("model_name"), "model_name", "left_semi")
    ranked = board.select("model", F.col("f1").between(0, 1).alias("ranked"))
    return outcome.join(ranked, "model", "left").join(stored.select(F.col("model_name").alias("model"), F.lit(True).alias("stored")), "model", "left")


def model_save_load(spark, d):
    rows, _ = _vectors(spark, d)
    root = scratch_path(spark, "models")
    fitted = G.fit_classifier("logistic_regression", _part(rows, "train"))
    G.save_classifier(fitted, root, spark)
    back = G.load_classifier("logistic_regression", root, spark).score(rows).select("doc_id", "spam_probability", "predicted")
    own = fitted.score(rows).select("doc_id", F.col("spam_probability").alias("p"), F.col("predicted").alias("y"))
    same = (F.col("spam_probability") == F.col("p")) & (F.col("predicted") == F.col("y"))
    return back.join(own, "doc_id").select("doc_id", same.alias("same"))


# ---- evaluation ------------------------------------------------------------------------


def _scored(function):
    return lambda spark, d: rounded(function(V.scored_rows(spark, d)))


def scoring_latency(spark, d):
    rows, vocabulary = _vectors(spark, d)
    scorers = {
        "naive_bayes": S.naive_bayes_scorer(_bayes(spark, d)),
        "logistic_regression": S.classifier_scorer(G.fit_classifier("logistic_regression", _part(rows, "train")), vocabulary),
    }
    jobs = {name: (lambda name=name: S.score_messages(V.messages(spark, d), scorers[name], name)) for name in scorers}
    timed = J.scoring_latency(jobs, spark)
    return timed.select("model", "n", (F.col("ms_per_row") > 0).alias("measured"))


# ---- log -------------------------------------------------------------------------------


def summary(spark, d):
    told = Q.summary(V.prediction_log(spark, d), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), G.MODEL_NAMES)
    return rounded(told.withColumn("models_available", joined("models_available")))


def timeline(spark, d):
    return Q.timeline(V.prediction_log(spark, d), as_of(), 7).withColumn("date", F.col("date").cast("string"))


def timeline_long(spark, d):
    log = V.prediction_log(spark, d).withColumn("prediction", F.col("model_used"))
    return Q.timeline_long(log, as_of(), 30).withColumn("date", F.col("date").cast("string"))


def prediction_history(spark, d):
    return rounded(
        Q.history(
            V.prediction_log(spark, d), USER, 20, 5, ("id", "prediction", "confidence", "model_used", "created_at")
        ).withColumn("created_at", F.col("created_at").cast("string"))
    )


def feedback_history(spark, d):
    page = Q.history(V.feedback_stored(spark, d), USER, 50, 0, ("id", "prediction_id", "correct_label", "created_at"))
    return page.withColumn("created_at", F.col("created_at").cast("string"))


def feedback_ingest(spark, d):
    return Q.feedback_ingest(
        V.feedback_batch(spark, d), V.prediction_log(spark, d), V.feedback_stored(spark, d)
    ).select("id", "prediction_id", "correct_label", "status")


def _users(spark, d):
    return V.table(spark, d, "events").filter(F.col("user_id") % 5 != 0).select(F.col("user_id").alias("id")).distinct()


def key_checks(spark, d):
    return Q.key_checks(V.prediction_log(spark, d), V.feedback_batch(spark, d), _users(spark, d))


def clear_missing_users(spark, d):
    return Q.clear_missing_users(V.prediction_log(spark, d), _users(spark, d)).select("id", "user_id")


def cascade_delete(spark, d):
    kept = V.prediction_log(spark, d).filter(F.col("id") % 4 != 0)
    return Q.cascade_delete(V.feedback_batch(spark, d), kept).select("id", "prediction_id")


def point_lookup(spark, d):
    return rounded(
        Q.point_lookup(V.prediction_log(spark, d), 77).select("id", "user_id", "prediction", "confidence")
    )


def model_benchmarks(spark, d):
    return rounded(Q.model_benchmarks(_results(spark, d)))


# ---- events ----------------------------------------------------------------------------


def _loads(spark, d):
    return V.prediction_log(spark, d).select("model_used", (F.col("processing_time_ms") / 10).alias("load_seconds"))


def in_flight_gauge(spark, d):
    return M.in_flight_gauge(V.requests(spark, d).withColumn("duration", F.col("duration") * 100000), 3600)


def rate_limit(spark, d):
    return M.rate_limit(V.requests(spark, d), RATE_LIMIT, RATE_WINDOW).select(
        "client", "event_id", "admitted", "remaining"
    )


def _table_stream(spark, d, name):
    """A table as a stream, whether it is one file or a folder of parts."""
    schema = V.table(spark, d, name).schema
    if is_file(spark, f"{d}/{name}.parquet"):
        return ST.read_stream(spark, d, schema, glob=f"{name}.parquet")
    return ST.read_stream(spark, f"{d}/{name}.parquet", schema)


def _events_stream(spark, d):
    events = _table_stream(spark, d, "events")
    return events.select("event_id", F.col("user_id").alias("client"), "ts", F.col("event_type").alias("endpoint"),
                         (F.col("value") / 1000).alias("duration"))


def rate_limit_stream(spark, d):
    path, checkpoint = scratch_path(spark, "rates"), scratch_path(spark, "checkpoint")
    ST.rate_limit_stream(_events_stream(spark, d), path, checkpoint, RATE_LIMIT, RATE_WINDOW).awaitTermination()
    return ST.read_decisions(spark, path).select("client", "event_id", "admitted", "remaining")


def metrics_stream(spark, d):
    path, checkpoint = scratch_path(spark, "metrics"), scratch_path(spark, "checkpoint")
    ST.metrics_stream(
        _events_stream(spark, d), ("endpoint",), "duration", M.REQUEST_SECONDS, path, checkpoint, width="1 hour"
    ).awaitTermination()
    return _metric_rows(ST.latest_metrics(spark, path, ("endpoint",)))


def metrics_batch(spark, d):
    return _metric_rows(
        ST.windowed_metrics(V.requests(spark, d), ("endpoint",), "duration", M.REQUEST_SECONDS, width="15 seconds")
    )


def _metric_rows(table):
    rows = M.stack_buckets(table, ("window_start", "endpoint"), M.REQUEST_SECONDS)
    return rounded(rows.withColumn("window_start", F.unix_seconds("window_start")))


# ---- augmentation ----------------------------------------------------------------------


def _augmented(function, needs_table):
    def query(spark, d):
        rows = V.messages(spark, d)
        changed = function(rows, synonyms(spark)) if needs_table else function(rows)
        return changed.select("doc_id", "text")

    return query


def augment_minority(spark, d):
    rows = I.dedupe_text(V.corpus(spark, d))
    return A.augment_minority(rows, synonyms(spark)).select("doc_id", "label_encoded", "synthetic", "text")


def augment_variants(spark, d):
    return A.augment_variants(V.messages(spark, d), 3, synonyms(spark)).select("doc_id", "draw_no", "text")


def class_balance(spark, d):
    return rounded(A.class_balance(V.corpus(spark, d)))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Labelled corpus to scored documents: message counts and mean confidence per label."""
    scorer = S.naive_bayes_scorer(_bayes(spark, d))
    scored = S.score_messages(V.messages(spark, d), scorer, "naive_bayes")
    return rounded(
        scored.groupBy("prediction").agg(
            F.count(F.lit(1)).alias("messages"), F.avg("confidence").alias("mean_confidence")
        )
    )


QUERIES = {
    "read_labelled_tsv": read_labelled_tsv,
    "read_labelled_csv": read_labelled_csv,
    "encode_label": encode_label,
    "drop_unknown_labels": drop_unknown_labels,
    "unknown_label_counts": unknown_label_counts,
    "dedupe_text": dedupe_text,
    "corpus_stats": corpus_stats,
    "stratified_split": stratified_split,
    "random_split": random_split,
    "split_summary": split_summary,
    "processed_roundtrip": processed_roundtrip,
    "file_checksums": file_checksums,
    "append_predictions": append_predictions,
    "benchmark_store": benchmark_store,
    "model_registry": model_registry,
    "clean_guard": _step(C.clean_guard),
    "strip_html_tags": _step(C.strip_html_tags, "html", _html, "page_id"),
    "html_unescape": _step(C.html_unescape, "html", _html, "page_id"),
    "fold_unicode": _step(C.fold_unicode),
    "mask_urls": _step(C.mask_urls),
    "mask_urls_html": _step(C.mask_urls, "html", _html, "page_id"),
    "mask_emails": _step(C.mask_emails),
    "mask_phones": _step(C.mask_phones),
    "handle_emoji": _step(C.handle_emoji),
    "mask_currency": _step(C.mask_currency),
    "mask_numbers": _step(C.mask_numbers),
    "lowercase": _step(C.lowercase),
    "drop_special_chars": _step(C.drop_special_chars),
    "squeeze_repeats": _step(C.squeeze_repeats),
    "squeeze_spaces": _step(C.squeeze_spaces),
    "min_length": _step(lambda c: C.min_length(c, 200)),
    "clean_text": clean_text,
    "clean_chat": clean_chat,
    "tokenize_whitespace": tokenize_whitespace,
    "tokenize_regex": _token_query(lambda t: t),
    "detokenize": detokenize,
    "token_fold": _token_query(K.token_fold, "whitespace"),
    "expand_slang": _token_query(K.expand_slang),
    "remove_stopwords": _token_query(K.remove_stopwords),
    "token_length_filter": _token_query(K.token_length_filter),
    "normalize_tokens": _token_query(K.normalize_tokens),
    "lemmatize": lemmatize,
    "tokenize_by_name": tokenize_by_name,
    "file_checksums_written": file_checksums_written,
    "scored_log_summary": scored_log_summary,
    "explain_errors": explain_errors,
    "stem_vocabulary": stem_vocabulary,
    "spam_keywords": spam_keywords,
    "spam_keyword_count": spam_keyword_count,
    "contact_flags": _columns(R.contact_flags),
    "uppercase_ratio": _columns(lambda t: {"uppercase_ratio": R.uppercase_ratio(t)}),
    "digit_ratio": _columns(lambda t: {"digit_ratio": R.digit_ratio(t)}),
    "special_char_ratio": _columns(lambda t: {"special_char_ratio": R.special_char_ratio(t)}),
    "text_lengths": text_lengths,
    "preprocess": preprocess_query,
    "ngram_terms": ngram_terms,
    "char_ngram_terms": char_ngram_terms,
    "document_frequency": document_frequency,
    "select_vocabulary": select_vocabulary,
    "idf": idf,
    "tfidf": tfidf,
    "feature_names": feature_names,
    "vocabulary_size": vocabulary_size,
    "top_idf_terms": top_idf_terms,
    "save_load_vectorizer": save_load_vectorizer,
    "build_vocab": build_vocab,
    "texts_to_sequences": texts_to_sequences,
    "naive_bayes": naive_bayes,
    "balanced_weights": balanced_weights,
    "logistic_regression": _classifier("logistic_regression"),
    "linear_svm": _classifier("svm"),
    "random_forest": _classifier("random_forest"),
    "boosted_trees": _classifier("xgboost"),
    "boosted_trees_leafwise": _classifier("lightgbm"),
    "train_all": train_all,
    "feature_importance": feature_importance,
    "model_save_load": model_save_load,
    "score_messages": score_messages,
    "score_batch": score_batch,
    "score_by_model": score_by_model,
    "score_two_models": score_two_models,
    "proba_argmax": proba_argmax,
    "score_stream": score_stream,
    "validate_requests": validate_requests,
    "explain_lime": _explained("lime"),
    "explain_shap": _explained("shap"),
    "classification_metrics": _scored(J.classification_metrics),
    "confusion_matrix": _scored(J.confusion_matrix),
    "roc_auc": _scored(J.roc_auc),
    "per_class_metrics": _scored(J.per_class_metrics),
    "classification_report": _scored(J.classification_report),
    "model_leaderboard": _scored(J.model_leaderboard),
    "best_model": _scored(lambda rows: J.best_model(J.model_leaderboard(rows))),
    "scoring_latency": scoring_latency,
    "summary": summary,
    "timeline": timeline,
    "timeline_long": timeline_long,
    "prediction_history": prediction_history,
    "feedback_history": feedback_history,
    "feedback_ingest": feedback_ingest,
    "key_checks": key_checks,
    "clear_missing_users": clear_missing_users,
    "cascade_delete": cascade_delete,
    "model_benchmarks": model_benchmarks,
    "point_lookup": point_lookup,
    "prediction_counts": lambda s, d: M.prediction_counts(V.prediction_log(s, d)),
    "latency_histogram": lambda s, d: rounded(M.latency_histogram(V.prediction_log(s, d))),
    "confidence_histogram": lambda s, d: rounded(M.confidence_histogram(V.prediction_log(s, d))),
    "request_counts": lambda s, d: M.request_counts(V.requests(s, d)),
    "request_duration_histogram": lambda s, d: rounded(M.request_duration_histogram(V.requests(s, d))),
    "in_flight_gauge": in_flight_gauge,
    "model_load_histogram": lambda s, d: rounded(M.model_load_histogram(_loads(s, d))),
    "rate_limit": rate_limit,
    "rate_limit_stream": rate_limit_stream,
    "metrics_stream": metrics_stream,
    "metrics_batch": metrics_batch,
    "synonym_replace": _augmented(A.synonym_replace, True),
    "random_insert": _augmented(A.random_insert, True),
    "random_swap": _augmented(A.random_swap, False),
    "random_delete": _augmented(A.random_delete, False),
    "char_noise": _augmented(A.char_noise, False),
    "augment_minority": augment_minority,
    "augment_variants": augment_variants,
    "class_balance": class_balance,
    "flagship": flagship,
}
