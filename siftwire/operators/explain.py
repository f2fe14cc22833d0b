"""Word-level explanations as distributed jobs over whole tables.

Every perturbed text is a row: perturbing, scoring and collecting the effects are joins and
aggregates over (document, sample). Only the local linear fit, at most ``num_samples`` rows
per document, runs in numpy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwire.functions import patterns as P
from siftwire.functions.draws import draw
from siftwire.operators.scoring import Scorer
from siftwire.plans.preprocess import PreprocessOptions, preprocess_to_text

# (rows with text, key column, small columns to keep) -> key, keep, both probabilities
Predict = Callable[[DataFrame, str, tuple[str, ...]], DataFrame]

PIECE = rf"[{P.WORD}]++|[^{P.WORD}]++"
TOP_WORDS = 5
KERNEL_WIDTH = 25.0

FIT_SCHEMA = (
    "key string, spam_probability double, ham_probability double, "
    "fitted array<struct<word:string,score:double,is_spam_indicator:boolean>>"
)


def predictor(
    scorer: Scorer, options: PreprocessOptions = PreprocessOptions(), lemmas: DataFrame | None = None
) -> Predict:
    """Preprocess and score: what an explanation perturbs is the raw text."""

    def predict(rows, key, keep):
        return scorer(preprocess_to_text(rows, "text", key, options, lemmas, keep), key, keep)

    return predict


def _pieces(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Words and separators of every text in order, and its distinct words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Spread the texts first: each of them turns into hundreds of rows where it stands.
    cut = df.select(id_col, text_col).repartition(F.col(id_col)).select(
        F.col(id_col).cast("string").alias("key"),
        F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)).alias("pieces"),
    )
    return cut.withColumn("all_words", F.filter("pieces", lambda p: p.rlike(rf"^[{P.WORD}]")))


def _result(scored: DataFrame, df: DataFrame, id_col: str, method: str) -> DataFrame:
    """One row per input; inputs nothing could be computed for report an error."""
    base = df.select(F.col(id_col), F.col(id_col).cast("string").alias("key"))
    spam, ham = F.col("spam_probability"), F.col("ham_probability")
    none = F.array().cast("array<string>")
    return base.join(scored, "key", "left").select(
        id_col,
        F.when(spam.isNull(), "error").when(spam > ham, "spam").otherwise("ham").alias("prediction"),
        F.coalesce(F.greatest(spam, ham), F.lit(0.0)).alias("confidence"),
        F.lit(method).alias("method"),
        F.coalesce(
            "word_importances",
            F.array().cast("array<struct<word:string,score:double,is_spam_indicator:boolean>>"),
        ).alias("word_importances"),
        F.coalesce("top_spam_words", none).alias("top_spam_words"),
        F.coalesce("top_ham_words", none).alias("top_ham_words"),
    )


def _top(cells: Column, spam: bool) -> Column:
    side = F.filter(cells, lambda c: c["is_spam_indicator"] if spam else ~c["is_spam_indicator"])
    return F.slice(F.transform(side, lambda c: c["word"]), 1, TOP_WORDS)


def _removed(seed: int) -> Column:
    """The words of ``words`` that sample ``sample`` of text ``key`` goes without, as structs (rank, at, word); none in sample 0."""
    drop = F.when(F.col("sample") == 0, 0).otherwise(
        F.pmod(draw(seed, "size", F.col("key"), F.col("sample")), F.size("words")) + 1
    )
    order = F.array_sort(
        F.transform(
            "words",
            lambda w, i: F.struct(
                draw(seed, "word", F.col("key"), F.col("sample"), i).alias("rank"), i.alias("at"), w.alias("word")
            ),
        )
    )
    return F.slice(order, F.lit(1), drop.cast("int"))


def explain_lime(
    df: DataFrame,
    predict: Predict,
    num_features: int = 15,
    num_samples: int = 500,
    seed: int = 42,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """Local linear fit on texts with hash-drawn words removed; sample 0 is the text itself."""
    docs = (
        _pieces(df, text_col, id_col)
        .withColumn("words", F.array_distinct("all_words"))
        .filter(F.size("words") > 0)
    )
    samples = docs.withColumn("sample", F.explode_outer(F.sequence(F.lit(0), F.lit(num_samples - 1))))
    # The generator keeps the drawn list from being worked out again for every piece.
    samples = samples.select("key", "sample", "pieces", F.explode_outer(F.array(_removed(seed))).alias("gone"))
    samples = samples.select(
        "key",
        "sample",
        F.concat_ws("#", "key", "sample").alias("row_key"),
        F.array_join(
            F.transform("pieces", lambda p: F.when(F.array_contains("gone.word", p), "").otherwise(p)), ""
        ).alias("text"),
    )
    scored = predict(samples, "row_key", ("key", "sample"))
    # What was removed follows from key and sample again: no perturbed text is joined, or built twice.
    cells = scored.select("key", "sample", "spam_probability", "ham_probability").join(docs.select("key", "words"), "key")
    cells = cells.withColumn("gone_at", _removed(seed)["at"])
    whole = F.col("sample") == 0
    done = (
        cells.groupBy("key")
        .agg(
            F.max(F.when(whole, F.col("spam_probability"))).alias("spam_probability"),
            F.max(F.when(whole, F.col("ham_probability"))).alias("ham_probability"),
            F.first("words").alias("words"),
            F.collect_list(F.struct("sample", "gone_at", F.col("spam_probability").alias("p"))).alias("rows"),
            F.count_if(F.col("spam_probability").isNull()).alias("failed"),
        )
        .filter("failed = 0")  # no fit, and so an error row, where the scorer failed on a sample
        .drop("failed")
        .mapInPandas(_linear_fit(num_features), FIT_SCHEMA)
        .select(
            "key",
            "spam_probability",
            "ham_probability",
            F.col("fitted").alias("word_importances"),
            _top(F.col("fitted"), True).alias("top_spam_words"),
            _top(F.col("fitted"), False).alias("top_ham_words"),
        )
    )
    return _result(done, df, id_col, "lime")


def _linear_fit(num_features: int, width: float = KERNEL_WIDTH):
    def fit(batches):
        import numpy as np
        import pandas as pd

        def ridge(x, y, w, alpha):
            """In samples rather than words where they are fewer; both forms have the same solution."""
            total, root = w.sum(), np.sqrt(w)
            xm, ym = (w @ x) / total, (w * y).sum() / total
            a, b = (x - xm) * root[:, None], (y - ym) * root
            if a.shape[1] <= a.shape[0]:
                return np.linalg.solve(a.T @ a + alpha * np.eye(a.shape[1]), a.T @ b)
            return a.T @ np.linalg.solve(a @ a.T + alpha * np.eye(a.shape[0]), b)

        for batch in batches:
            out = []
            for key, spam, ham, words, rows in zip(
                *(batch[c] for c in ("key", "spam_probability", "ham_probability", "words", "rows"))
            ):
                rows = sorted(rows, key=lambda r: r["sample"])
                x = np.ones((len(rows), len(words)))
                for i, r in enumerate(rows):
                    x[i, list(r["gone_at"])] = 0.0
                y = np.array([r["p"] for r in rows])
                closeness = np.sqrt(x.mean(1))  # cosine with the full text
                distance = (1.0 - closeness) * 100.0
                w = np.sqrt(np.exp(-(distance**2) / width**2))
                first = ridge(x, y, w, 0.01)
                used = np.argsort(-np.abs(first), kind="stable")[:num_features]
                weights = ridge(x[:, used], y, w, 1.0)
                ranked = np.argsort(-np.abs(weights), kind="stable")
                out.append(
                    (
                        key,
                        spam,
                        ham,
                        [
                            {
                                "word": words[used[k]],
                                "score": float(weights[k]),
                                "is_spam_indicator": bool(weights[k] > 0),
                            }
                            for k in ranked
                        ],
                    )
                )
            yield pd.DataFrame(out, columns=["key", "spam_probability", "ham_probability", "fitted"])

    return fit


def explain_shap(
    df: DataFrame,
    predict: Predict,
    max_evals: int = 500,
    num_features: int = 15,
    seed: int = 42,
    text_col: str = "text",
    id_col: str = "doc_id",
    block_words: int = 1,
) -> DataFrame:
    """Shapley values of the words for the spam class by hash-drawn permutations.

    Words join one after the other in the drawn order; the change of the spam probability is
    the word's share, averaged over permutations, so shares add up to f(text) - f(no words).
    Every text has one whole permutation at least, and more while ``max_evals`` allows. With
    ``block_words`` above 1 that many neighbouring words join together and divide their share evenly.
    """
    docs = _pieces(df, text_col, id_col).filter(F.size("all_words") > 0)
    size = F.size("all_words")
    docs = docs.withColumn("block", F.lit(block_words))
    docs = docs.withColumn("players", F.ceil(size / F.col("block")).cast("int"))
    docs = docs.withColumn(
        "permutations", F.greatest(F.lit(1), F.floor(F.lit(max_evals) / (F.col("players") + 1))).cast("int")
    )
    # Word pieces carry the number of their player, separators none.
    is_word = lambda p: p.rlike(rf"^[{P.WORD}]")
    first_is_word = F.when(is_word(F.col("pieces")[0]), 0).otherwise(1)
    docs = docs.withColumn("offset", first_is_word)
    owned = F.transform(
        "pieces",
        lambda p, i: F.struct(
            p.alias("piece"),
            F.when(
                F.pmod(i + F.col("offset"), F.lit(2)) == 0,
                F.floor(F.floor((i - F.col("offset")) / 2) / F.col("block")).cast("int"),
            ).otherwise(-1).alias("player"),
        ),
    )
    docs = docs.withColumn("owned", owned)
    turns = docs.withColumn("turn", F.explode_outer(F.sequence(F.lit(1), F.col("permutations"))))
    order = F.transform(
        F.array_sort(
            F.transform(
                F.sequence(F.lit(0), F.col("players") - 1),
                lambda i: F.struct(draw(seed, "player", F.col("key"), F.col("turn"), i).alias("rank"), i.alias("at")),
            )
        ),
        lambda c: c["at"],
    )
    turns = turns.withColumn("order", order)
    # The place of each player in the order, by player: one look-up tells whether a piece is present.
    placed = F.array_sort(F.transform("order", lambda at, i: F.struct(at.alias("at"), (i + 1).alias("place"))))
    turns = turns.withColumn("place_of", F.transform(placed, lambda c: c["place"]))
    steps = turns.select(
        "key", "turn", "place_of", "owned",
        F.posexplode_outer(F.concat(F.array(F.lit(-1)), F.col("order"))).alias("step", "player"),
    )
    steps = steps.select(
        "key",
        "turn",
        "step",
        "player",
        F.concat_ws("#", "key", "turn", "step").alias("row_key"),
        F.array_join(
            F.transform(
                "owned",
                lambda o: F.when(
                    (o["player"] < 0) | (F.get("place_of", o["player"]) <= F.col("step")), o["piece"]
                ).otherwise(""),
            ),
            "",
        ).alias("text"),
    )
    keep = ("key", "turn", "step", "player")
    scored = predict(steps, "row_key", keep)
    # At most max_evals rows per document and turn.
    gain = F.col("spam_probability") - F.lag("spam_probability", 1).over(
        Window.partitionBy("key", "turn").orderBy("step")
    )
    # The last step of a turn is the whole text.
    last = F.max(F.struct("step", "spam_probability", "ham_probability"))
    shares = (
        scored.withColumn("gain", gain)
        .groupBy("key", "player")
        .agg(F.avg("gain").alias("share"), last.alias("last"), F.count_if(F.col("spam_probability").isNull()).alias("failed"))
        .groupBy("key")
        .agg(
            F.sum("failed").alias("failed"),
            F.map_from_entries(
                F.collect_list(F.when(F.col("player") >= 0, F.struct("player", "share")))
            ).alias("shares"),
            F.max("last").alias("last"),
        )
        .filter("failed = 0")
        .drop("failed")
    )
    words = docs.select(
        "key",
        "block",
        F.posexplode_outer("all_words").alias("pos", "word"),
        size.alias("n_words"),
    )
    valued = words.join(shares, "key").select(
        "key",
        "pos",
        "word",
        "last",
        (
            F.col("shares")[F.floor(F.col("pos") / F.col("block")).cast("int")]
            / F.least(
                F.col("block"),
                F.col("n_words") - F.floor(F.col("pos") / F.col("block")).cast("int") * F.col("block"),
            )
        ).alias("score"),
    )
    cell = F.struct("word", "score", (F.col("score") > 0).alias("is_spam_indicator"))
    lists = valued.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("pos", cell.alias("cell")))).alias("in_order"),
        F.max("last").alias("last"),
    ).withColumn("in_order", F.col("in_order.cell"))
    by_size = F.transform(
        F.array_sort(
            F.transform(
                "in_order", lambda c, i: F.struct((-F.abs(c["score"])).alias("size"), i.alias("at"), c.alias("cell"))
            )
        ),
        lambda c: c["cell"],
    )
    done = lists.select(
        "key",
        "last.spam_probability",
        "last.ham_probability",
        F.slice(by_size, 1, num_features).alias("word_importances"),
        _top(F.col("in_order"), True).alias("top_spam_words"),
        _top(F.col("in_order"), False).alias("top_ham_words"),
    )
    return _result(done, df, id_col, "shap")


def explain(df: DataFrame, predict: Predict, method: str = "lime", **kwargs) -> DataFrame:
    if method == "lime":
        return explain_lime(df, predict, **kwargs)
    if method == "shap":
        return explain_shap(df, predict, **kwargs)
    raise ValueError(f"unknown method '{method}', use lime or shap")
