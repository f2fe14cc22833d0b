"""Six classical classifiers behind one surface: fit, score, importance, save, load."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml import classification as C
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwire.functions.draws import draw
from siftwire.operators import features as X
from siftwire.operators.boosting import BoostedTrees, Growth
from siftwire.operators.boosting import fit as fit_trees
from siftwire.operators.machines import Machines, fit_machines
from siftwire.session import stored


@dataclass
class ModelCard:
    """What is stored next to a model."""

    model_name: str = ""
    model_type: str = "traditional"
    version: str = "1.0.0"
    accuracy: float = 0.0
    precision: float = 0.0
    recall: float = 0.0
    f1_score: float = 0.0
    training_time_seconds: float = 0.0
    training_samples: int = 0
    hyperparameters: dict = field(default_factory=dict)
    feature_type: str = "tfidf"


def balanced_weights(df: DataFrame, label_col: str = "label_encoded") -> DataFrame:
    """Add ``weight``: rows / (classes x rows of the class).

    The class counts are aggregated first and broadcast back (one row per class), so no row
    of the corpus moves.
    """
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("class_rows"))
    every = Window.partitionBy()
    weights = counts.select(
        label_col,
        (F.sum("class_rows").over(every) / (F.count(F.lit(1)).over(every) * F.col("class_rows"))).alias("weight"),
    )
    return df.join(F.broadcast(weights), label_col).select(*df.columns, "weight")


# ---- naive Bayes as aggregates ------------------------------------------------------------


@dataclass
class NaiveBayes:
    """Multinomial naive Bayes: ``terms(term, idx, idf, ham_logp, spam_logp)`` and two priors."""

    terms: DataFrame
    priors: DataFrame
    options: X.TfidfOptions = X.CLEANED
    name: str = "naive_bayes"


def train_naive_bayes(
    weights: DataFrame,
    documents: DataFrame,
    vocabulary: DataFrame,
    alpha: float = 1.0,
    fit_prior: bool = True,
    options: X.TfidfOptions = X.CLEANED,
    label_col: str = "label_encoded",
) -> NaiveBayes:
    """Fit from long-form ``tfidf`` rows that carry the label, and the labelled documents.

    Term sums are combined map-side before their shuffle; the rest works on tables of one
    row per term or per class.
    """
    label = F.col(label_col)
    sums = weights.groupBy("term").agg(
        F.sum(F.when(label == 0, F.col("tfidf")).otherwise(0.0)).alias("ham_sum"),
        F.sum(F.when(label == 1, F.col("tfidf")).otherwise(0.0)).alias("spam_sum"),
    )
    joined = vocabulary.select("term", "idx", "idf").join(sums, "term", "left").fillna(0.0)
    every = Window.partitionBy()  # at most max_features rows
    size = F.count(F.lit(1)).over(every)

    def log_probability(name):
        total = F.sum(name).over(every) + F.lit(alpha) * size
        return F.log(F.col(name) + F.lit(alpha)) - F.log(total)

    terms = joined.select(
        "term",
        "idx",
        "idf",
        log_probability("ham_sum").alias("ham_logp"),
        log_probability("spam_sum").alias("spam_logp"),
    )
    share = F.log(F.count_if(label == 1) / F.count_if(label.isNotNull())), F.log(
        F.count_if(label == 0) / F.count_if(label.isNotNull())
    )
    priors = documents.agg(
        (share[1] if fit_prior else F.log(F.lit(0.5))).alias("ham_prior"),
        (share[0] if fit_prior else F.log(F.lit(0.5))).alias("spam_prior"),
    )
    return NaiveBayes(terms, priors, options)


def fit_naive_bayes(
    train: DataFrame,
    text_col: str = "final_text",
    id_col: str = "doc_id",
    label_col: str = "label_encoded",
    options: X.TfidfOptions = X.CLEANED,
    alpha: float = 1.0,
) -> NaiveBayes:
    """Vocabulary, TF-IDF and naive Bayes from labelled texts, which are stored first: preparing them is the dear part."""
    train = stored(train.select(id_col, label_col, text_col), "labelled-texts")
    counts = X.term_counts(train, text_col, id_col, options, keep=(label_col,))
    vocabulary = stored(X.select_vocabulary(X.document_frequency(counts), X.document_total(train), options), "vocabulary")
    packed = X.term_counts(train, text_col, id_col, options, keep=(label_col,), packed=True)
    weights = X.tfidf(packed, vocabulary, id_col, options)
    return train_naive_bayes(weights, train, vocabulary, alpha, True, options, label_col)


def score_naive_bayes(
    model: NaiveBayes,
    texts: DataFrame,
    text_col: str = "final_text",
    id_col: str = "doc_id",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id, *keep, ham_probability, spam_probability`` for every text.

    The dot product with the unit-length vector is summed up where a document's terms are counted; no vector is
    built and nothing is sorted. ``keep`` should name small columns only.
    """
    counts = X.term_counts(texts, text_col, id_col, model.options, keep, outer=True, packed=True)
    prior = model.priors.select((F.col("spam_prior") - F.col("ham_prior")).alias("gain")).scalar()
    scored = X.tfidf_dots(counts, model.terms, F.col("spam_logp") - F.col("ham_logp"), id_col, keep, model.options)
    odds = F.col("dot") + prior
    return scored.select(
        id_col,
        *keep,
        (F.lit(1.0) / (F.lit(1.0) + F.exp(odds))).alias("ham_probability"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))).alias("spam_probability"),
    )


def save_naive_bayes(model: NaiveBayes, root: str) -> str:
    """Write the term table and the priors; scoring then reads two small tables."""
    path = f"{root.rstrip('/')}/{model.name}"
    model.terms.write.mode("overwrite").parquet(f"{path}/terms")
    model.priors.write.mode("overwrite").parquet(f"{path}/priors")
    card = ModelCard(model_name=model.name, hyperparameters=settings("naive_bayes"))
    write_card(card, path, model.terms.sparkSession)
    return path


def load_naive_bayes(
    spark: SparkSession, root: str, options: X.TfidfOptions = X.CLEANED, name: str = "naive_bayes"
) -> NaiveBayes:
    path = f"{root.rstrip('/')}/{name}"
    try:
        return NaiveBayes(
            spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/priors"), options, name
        )
    except Exception as error:
        raise FileNotFoundError(f"no model under {path}, train it first") from error


# ---- Spark ML estimators ------------------------------------------------------------------

# Default settings of the named models.
DEFAULTS: dict[str, dict] = {
    "naive_bayes": {"alpha": 1.0, "fit_prior": True},
    "logistic_regression": {"C": 1.0, "max_iter": 1000, "tol": 1e-4, "class_weight": "balanced"},
    "svm": {"C": 1.0, "max_iter": 5000, "tol": 1e-6, "class_weight": "balanced", "folds": 3},
    "random_forest": {"trees": 200, "max_depth": 30, "min_split": 5, "class_weight": "balanced", "seed": 42},
    "xgboost": {"rounds": 200, "depth": 6, "eta": 0.1, "rows": 0.8, "columns": 0.8, "l2": 1.0, "min_hessian": 1.0,
                "min_rows": 1, "patience": 10, "seed": 42},
    # Rows are not sampled: the named setting has no effect without a bagging frequency, whose default is none.
    "lightgbm": {"rounds": 200, "leaves": 31, "eta": 0.1, "columns": 0.8, "l2": 0.0, "min_hessian": 1e-3,
                 "min_rows": 20, "patience": 10, "class_weight": "balanced", "seed": 42},
}
MODEL_NAMES = tuple(DEFAULTS)


def settings(name: str, **overrides) -> dict:
    if name not in DEFAULTS:
        raise ValueError(f"unknown model '{name}', available: {', '.join(MODEL_NAMES)}")
    return {**DEFAULTS[name], **overrides}


#: Models that are tables of numbers of our own, not Spark ML stages, and how to read them back.
OWN_MODELS = {"svm": Machines, "xgboost": BoostedTrees, "lightgbm": BoostedTrees}


@dataclass
class Classifier:
    """A fitted model with its card: a Spark ML model, boosted trees or calibrated machines."""

    name: str
    model: object
    card: ModelCard

    def score(self, vectors: DataFrame) -> DataFrame:
        """Add ``ham_probability``, ``spam_probability`` and the label of the larger one."""
        kept = [F.col(f"`{c}`") for c in vectors.columns]
        spam = F.col("spam_probability")
        if isinstance(self.model, (BoostedTrees, Machines)):
            return self.model.score(vectors).select(
                *kept, (F.lit(1.0) - spam).alias("ham_probability"), spam, (spam > 0.5).cast("int").alias("predicted")
            )
        both = vector_to_array(F.col("probability"))
        return self.model.transform(vectors).select(
            *kept,
            both[0].alias("ham_probability"),
            both[1].alias("spam_probability"),
            F.col("prediction").cast("int").alias("predicted"),
        )


def fit_classifier(
    name: str,
    train: DataFrame,
    validation: DataFrame | None = None,
    label_col: str = "label_encoded",
    id_col: str = "doc_id",
    **overrides,
) -> Classifier:
    """Fit one model by name on ``features`` and a 0 / 1 label.

    Boosting uses the validation rows to stop early if they are given. The support vector
    machine is an ensemble of ``folds`` machines, each calibrated on the fold it has not seen; folds
    are drawn by id.
    """
    p = settings(name, **overrides)
    started = time.perf_counter()
    rows = balanced_weights(train, label_col) if p.get("class_weight") else train.withColumn("weight", F.lit(1.0))
    rows = rows.withColumn("label", F.col(label_col).cast("double"))
    common = dict(featuresCol="features", labelCol="label", weightCol="weight")
    n = train.count()
    if name == "naive_bayes":
        model = C.NaiveBayes(smoothing=p["alpha"], **common).fit(rows)
    elif name == "logistic_regression":
        # Balanced weights add up to the row count, which makes the penalties equal.
        model = C.LogisticRegression(
            regParam=1.0 / (p["C"] * n), elasticNetParam=0.0, standardization=False,
            maxIter=p["max_iter"], tol=p["tol"], **common,
        ).fit(rows)
    elif name == "svm":
        fold = F.pmod(draw(42, F.col(id_col)), F.lit(p["folds"])).cast("int").alias("fold")
        size = rows.select("features").first()[0].size
        signed = rows.select((F.col("label") * 2 - 1).alias("sign"), "weight", fold, "features")
        model = fit_machines(signed, size, p["folds"], p["C"], p["tol"], p["max_iter"])
    elif name == "random_forest":
        model = C.RandomForestClassifier(
            numTrees=p["trees"], maxDepth=p["max_depth"], minInstancesPerNode=max(1, p["min_split"] // 2),
            seed=p["seed"], **common,
        ).fit(rows)
    else:
        key = F.xxhash64(id_col).alias("key")
        kept = [key, "label", "weight", "features"]
        both = rows.select(*kept, F.lit(False).alias("held"))
        if validation is not None:
            held = validation.withColumns({"weight": F.lit(1.0), "label": F.col(label_col).cast("double")})
            both = both.unionByName(held.select(*kept, F.lit(True).alias("held")))
        growth = {k: v for k, v in p.items() if k in Growth.__dataclass_fields__}
        model = fit_trees(both, Growth(**growth))
    card = ModelCard(
        model_name=name,
        training_time_seconds=time.perf_counter() - started,
        training_samples=n,
        hyperparameters={k: str(v) for k, v in p.items()},
    )
    return Classifier(name, model, card)


def train_all(
    train: DataFrame,
    names: tuple[str, ...] = MODEL_NAMES,
    validation: DataFrame | None = None,
    overrides: dict[str, dict] | None = None,
    **kwargs,
) -> tuple[list[Classifier], dict[str, str]]:
    """Fit several models on one persisted feature table; a failure does not stop the others."""
    for name in names:
        settings(name)
    table = train.persist()
    fitted, failures = [], {}
    try:
        for name in names:
            try:
                fitted.append(
                    fit_classifier(name, table, validation, **kwargs, **(overrides or {}).get(name, {}))
                )
            except Exception as error:  # noqa: BLE001 - reported per model
                failures[name] = str(error)
    finally:
        table.unpersist()
    return fitted, failures


def feature_importance(classifier: Classifier, vocabulary: DataFrame, n: int = 20) -> DataFrame:
    """Top ``n`` terms: signed weight by magnitude for linear models, importance for trees."""
    model = classifier.model
    if isinstance(model, BoostedTrees):
        size = vocabulary.agg(F.max("idx")).first()[0] + 1
        values = model.importances(size, "splits" if classifier.name == "lightgbm" else "gain")
    elif hasattr(model, "coefficients"):
        values = model.coefficients.toArray()
    elif hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    else:
        raise ValueError(f"model '{classifier.name}' has no feature importance")
    spark = vocabulary.sparkSession
    import pandas as pd

    # One number per vocabulary term: bounded by max_features.
    scores = spark.createDataFrame(
        pd.DataFrame({"idx": range(len(values)), "importance": values}), "idx int, importance double"
    )
    return (
        vocabulary.join(F.broadcast(scores), "idx")
        .select("term", "importance")
        .orderBy(F.abs("importance").desc(), "term")
        .limit(n)
    )


# ---- storage ------------------------------------------------------------------------------


CARD_SCHEMA = (
    "model_name string, model_type string, version string, accuracy double, precision double, "
    "recall double, f1_score double, training_time_seconds double, training_samples bigint, "
    "hyperparameters map<string,string>, feature_type string"
)


def save_classifier(classifier: Classifier, root: str, spark: SparkSession) -> str:
    """Write the model and its card under ``root/name``."""
    path = f"{root.rstrip('/')}/{classifier.name}"
    if classifier.name in OWN_MODELS:
        classifier.model.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    else:
        PipelineModel(stages=[classifier.model]).write().overwrite().save(f"{path}/model")
    write_card(classifier.card, path, spark)
    return path


def write_card(card: ModelCard, path: str, spark: SparkSession) -> None:
    row = asdict(card)
    names = [part.split()[0] for part in CARD_SCHEMA.split(", ")]
    values = [tuple(row[k] if k != "hyperparameters" else {a: str(b) for a, b in row[k].items()} for k in names)]
    spark.createDataFrame(values, CARD_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{path}/metadata.json")


def read_card(path: str, spark: SparkSession) -> ModelCard:
    row = spark.read.schema(CARD_SCHEMA).json(f"{path}/metadata.json").first()
    return ModelCard(**row.asDict())


def load_classifier(name: str, root: str, spark: SparkSession) -> Classifier:
    path = f"{root.rstrip('/')}/{name}"
    try:
        if name in OWN_MODELS:
            model = OWN_MODELS[name].of_table(spark.read.parquet(f"{path}/model"))
        else:
            model = PipelineModel.load(f"{path}/model").stages[0]
    except Exception as error:
        raise FileNotFoundError(f"no model under {path}, train it first") from error
    return Classifier(name, model, read_card(path, spark))
