"""Labelled corpus: encode, drop, dedupe, describe and split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwire.functions import wordlists as W

SPLIT_BUCKET_HEX = 4  # 65,536 buckets per class: the bound of every table that is broadcast


def label_code(label: Column, dtype: T.DataType) -> Column:
    """ham / spam to 0 / 1 for strings, a plain cast for numbers."""
    if isinstance(dtype, T.StringType):
        code = F.lit(None).cast("int")
        for name, value in W.LABEL_CODES.items():
            code = F.when(label == name, F.lit(value)).otherwise(code)
        return code
    return label.cast("int")


def encode_label(df: DataFrame, label_col: str = "label") -> DataFrame:
    dtype = df.schema[label_col].dataType
    return df.withColumn("label_encoded", label_code(F.col(label_col), dtype))


def drop_unknown_labels(df: DataFrame, text_col: str | None = None) -> DataFrame:
    """Keep rows with a known label (and, if a text column is named, with a text)."""
    kept = df.filter(F.col("label_encoded").isNotNull())
    return kept.filter(F.col(text_col).isNotNull()) if text_col else kept


def unknown_label_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.col("label_encoded").isNotNull()).alias("kept"),
        F.count_if(F.col("label_encoded").isNull()).alias("dropped"),
    )


def dedupe_text(df: DataFrame, text_col: str = "text", order_col: str = "doc_id") -> DataFrame:
    """First row of every distinct text, in the order of ``order_col``.

    An aggregate, not a window: copies collapse before the shuffle, so a text that makes up
    a third of the corpus costs one row per map task.
    """
    others = [c for c in df.columns if c not in (text_col, order_col)]
    first = df.groupBy(text_col).agg(
        F.min_by(F.struct(order_col, *others), order_col).alias("first_row")
    )
    return first.select(
        *[F.col(text_col) if c == text_col else F.col(f"first_row.{c}").alias(c) for c in df.columns]
    )


def corpus_stats(df: DataFrame) -> DataFrame:
    code = F.col("label_encoded")
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(code == 0).alias("ham"),
        F.count_if(code == 1).alias("spam"),
        (F.avg(code) * 100).alias("spam_percent"),
    )


def split_key(seed: int, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def _allocate(counts: DataFrame, share: Column) -> DataFrame:
    """Split every class count so that the parts add up to the rounded total.

    ``counts`` has one row per class (``label``, ``n``); each class gets its whole share and
    the rest goes to the largest remainders, as stratified sampling does.
    """
    every = Window.partitionBy()
    total = F.sum("n").over(every)
    wanted = total - F.ceil(total * share)
    exact = F.col("n") * wanted / total
    base = F.floor(exact)
    sized = counts.withColumn("wanted", wanted).withColumn("exact", exact).withColumn("base", base)
    missing = F.col("wanted") - F.sum("base").over(every)
    rank = F.row_number().over(Window.orderBy((F.col("exact") - F.col("base")).desc(), "label"))
    return sized.select(
        "label",
        "n",
        (F.col("base") + F.when(rank <= missing, 1).otherwise(0)).cast("bigint").alias("kept"),
    )


def stratified_split(
    df: DataFrame,
    test_size: float = 0.2,
    val_size: float = 0.1,
    seed: int = 42,
    stratify: bool = True,
    label_col: str = "label_encoded",
    id_col: str = "doc_id",
) -> DataFrame:
    """Add ``split`` (train / val / test) with equal class shares.

    Rows are ordered by a hash of the id inside each class; the last ones are test, those
    before them validation. Exact cut points are found from counts per hash bucket and a
    ranking of the buckets the cuts fall in, so the corpus itself is never shuffled.
    """
    hashed = df.withColumn("split_hash", split_key(seed, F.col(id_col)))
    stratum = F.col(label_col) if stratify else F.lit(0)
    hashed = hashed.withColumn("stratum", stratum)
    bucket = F.substring("split_hash", 1, SPLIT_BUCKET_HEX)

    buckets = hashed.groupBy("stratum", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    classes = buckets.groupBy(F.col("stratum").alias("label")).agg(F.sum("rows").alias("n"))
    trainval = _allocate(classes, F.lit(test_size)).select("label", F.col("kept").alias("n"))
    cuts = _allocate(trainval, F.lit(val_size / (1 - test_size))).select(
        F.col("label").alias("stratum"),
        F.col("kept").alias("train_rows"),
        F.col("n").alias("trainval_rows"),
    )

    by_bucket = Window.partitionBy("stratum").orderBy("bucket")
    offsets = buckets.withColumn("before", F.sum("rows").over(by_bucket) - F.col("rows"))
    marks = offsets.join(F.broadcast(cuts), "stratum").select(
        "stratum", "bucket", "before", "rows", F.explode(F.array("train_rows", "trainval_rows")).alias("cut")
    )
    # A cut inside a bucket is the hash of the first row after it; one such bucket per cut.
    marks = marks.filter(
        (F.col("cut") >= F.col("before")) & (F.col("cut") < F.col("before") + F.col("rows"))
    )
    ranked = (
        hashed.select("stratum", "split_hash", id_col, bucket.alias("bucket"))
        .join(F.broadcast(marks), ["stratum", "bucket"])
        .withColumn(
            "place",
            F.col("before")
            + F.row_number().over(
                Window.partitionBy("stratum", "bucket", "cut").orderBy("split_hash", id_col)
            )
            - 1,
        )
        .filter(F.col("place") == F.col("cut"))
        .select("stratum", "cut", F.struct("split_hash", id_col).alias("edge"))
    )
    edges = (
        cuts.join(
            ranked.select("stratum", F.col("cut").alias("train_rows"), F.col("edge").alias("val_from")),
            ["stratum", "train_rows"],
            "left",
        )
        .join(
            ranked.select("stratum", F.col("cut").alias("trainval_rows"), F.col("edge").alias("test_from")),
            ["stratum", "trainval_rows"],
            "left",
        )
        .select("stratum", "val_from", "test_from")
    )
    here = F.struct(F.col("split_hash"), F.col(id_col))
    # No edge means the cut lies behind the last row: nothing of that part in this class.
    split = (
        F.when(here >= F.col("test_from"), "test")
        .when(here >= F.col("val_from"), "val")
        .otherwise("train")
    )
    return (
        hashed.join(F.broadcast(edges), "stratum", "left")
        .withColumn("split", split)
        .select(*df.columns, "split")
    )


def split_summary(df: DataFrame, label_col: str = "label_encoded") -> DataFrame:
    code = F.col(label_col)
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(code == 1).alias("spam"),
        F.count_if(code == 0).alias("ham"),
        F.avg(code).alias("spam_ratio"),
    )
