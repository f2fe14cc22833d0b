"""Readers and writers of labelled corpora, file manifests and the prediction log."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwire.operators import ingest as I
from siftwire.session import finished_parts


def read_labelled_tsv(
    spark: SparkSession, path: str, quote: str | None = '"', na_values: tuple[str, ...] = (),
    encoding: str = "ISO-8859-1", multi_line: bool = False,
) -> DataFrame:
    """Headerless ``label TAB text``: text, label and code.

    ``quote`` and ``na_values`` say outright what a leading quotation mark and a text like
    ``NA`` mean. With ``multi_line`` a quoted text may span lines, and a file is read by one task.
    """
    reader = (
        spark.read.schema("label string, text string")
        .option("sep", "\t")
        .option("encoding", encoding)
        .option("quote", quote or "")
        .option("escape", quote or "")
        .option("multiLine", multi_line)
    )
    df = reader.csv(path)
    if na_values:
        df = df.withColumn("text", F.when(~F.col("text").isin(*na_values), F.col("text")))
    return I.drop_unknown_labels(I.encode_label(df)).select("text", "label", "label_encoded")


def read_labelled_csv(
    spark: SparkSession, path: str, text_column: str = "text", label_column: str = "label",
    numeric_labels: bool = False, multi_line: bool = False,
) -> DataFrame:
    """CSV with a header and caller-named columns; a missing column fails at once.

    With ``multi_line`` a quoted text may span lines, and a file is read by one task.
    """
    df = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    for name in (text_column, label_column):
        if name not in df.columns:
            raise ValueError(f"column '{name}' not found in {path}")
    df = df.withColumnRenamed(text_column, "text").withColumnRenamed(label_column, "label")
    if numeric_labels:
        df = df.withColumn("label", F.col("label").cast("double"))
    return I.drop_unknown_labels(I.encode_label(df), "text")


def load_corpus(df: DataFrame, order_col: str = "doc_id") -> DataFrame:
    """Encode, drop unknown labels, keep the first of equal texts."""
    return I.dedupe_text(I.drop_unknown_labels(I.encode_label(df)), "text", order_col)


def save_processed(df: DataFrame, root: str, name: str) -> str:
    path = f"{root.rstrip('/')}/{name}.parquet"
    df.write.mode("overwrite").parquet(path)
    return path


def load_processed(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = f"{root.rstrip('/')}/{name}.parquet"
    try:
        return spark.read.parquet(path)
    except Exception as error:
        raise FileNotFoundError(f"no processed data under {path}") from error


#: Files up to so many bytes are digested as one value; longer ones are read piece by piece.
WHOLE_BYTES = 64 << 20
PIECE_BYTES = 4 << 20


def file_checksums(
    spark: SparkSession, path: str, glob: str = "*", whole_bytes: int = WHOLE_BYTES, piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """Path, length and SHA-256 of every file of any length; contents stay on the executors.

    A file above ``whole_bytes`` is a stream that one task reads in pieces, as its digest is one
    chain; many such files are many tasks. The task opens it by its address, so its store has to be one that
    Arrow knows (local, HDFS, S3, GCS and the like); shorter files can be wherever Spark reads.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    short = files.filter(F.col("length") <= whole_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for address in batch.column(0).to_pylist():
                store, name = pa_fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", address))
                chain = hashlib.sha256()
                with store.open_input_stream(name) as stream:
                    while piece := stream.read(piece_bytes):
                        chain.update(piece)
                told.append(chain.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told, pa.string())], ["path", "length", "sha256"])

    long = files.filter(F.col("length") > whole_bytes).select("path", "length").repartition("path")
    # Spark reads no empty files, but its index, which the driver holds in any case, lists them.
    listed = spark.createDataFrame([(re.sub(r"^file:/+", "file:/", p),) for p in files.inputFiles()], "path string")
    empty = listed.join(files.select("path"), "path", "left_anti")
    empty = empty.select("path", F.lit(0).cast("long").alias("length"), F.sha2(F.lit(b""), 256).alias("sha256"))
    return short.unionByName(long.mapInArrow(digest, "path string, length long, sha256 string")).unionByName(empty)


#: What tells the rows of the prediction log apart.
LOG_KEY = ("id", "text_key", "model_used")


def append_predictions(log: DataFrame, path: str, part: str | None = None) -> None:
    """Add rows to the prediction log: a part of its own, one folder per day in it.

    A part counts once its job has committed. Rows whose id, text and model the log has already are
    left out, and a part that is there already stays as it is: writing again, whether after a
    failure or by a new writer over the same messages, changes nothing. Rows repeated inside ``log`` are one.
    """
    spark = log.sparkSession
    part = part or uuid.uuid4().hex
    if f"part={part}" in finished_parts(spark, path, "part="):
        return
    rows = _log_rows(log).dropDuplicates(list(LOG_KEY))
    if finished_parts(spark, path, "part="):
        known = _whole_log(spark, path).select(*(F.col(c).alias(f"known_{c}") for c in LOG_KEY))
        same = [F.col(c).eqNullSafe(F.col(f"known_{c}")) for c in LOG_KEY]
        rows = rows.join(known, same[0] & same[1] & same[2], "left_anti")
    rows = rows.withColumn("created_date", F.to_date("created_at"))
    rows.write.mode("overwrite").partitionBy("created_date").parquet(f"{path}/part={part}")


def _log_rows(log: DataFrame) -> DataFrame:
    """``log`` with the columns of LOG_SCHEMA in its types; those it lacks are null."""
    fields = (f.rsplit(" ", 1) for f in LOG_SCHEMA.split(", "))
    given = {c: F.col(f"`{c}`") for c in log.columns} | {"text_key": F.xxhash64("input_text") if "input_text" in log.columns else F.lit(0)}
    return log.select(*(given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields if name not in ("part", "created_date")))


def _whole_log(spark: SparkSession, path: str) -> DataFrame:
    parts = finished_parts(spark, path, "part=")
    if not parts:
        raise FileNotFoundError(f"no prediction log under {path}")
    return spark.read.schema(LOG_SCHEMA).option("basePath", path).parquet(*(f"{path}/{p}" for p in parts))


def read_predictions(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """The log, whoever wrote it; ``since`` (a date) prunes day folders."""
    df = _whole_log(spark, path).drop("part", "text_key")
    return df.filter(F.col("created_date") >= since) if since is not None else df


LOG_SCHEMA = (
    "id string, user_id string, input_text string, prediction string, confidence double, spam_probability double, "
    "ham_probability double, model_used string, processing_time_ms double, has_url boolean, text_length int, "
    "spam_keyword_count int, source string, created_at timestamp, text_key bigint, part string, created_date date"
)


RESULT_SCHEMA = (
    "model_name string, accuracy double, precision double, recall double, f1 double, roc_auc double, "
    "confusion_matrix array<array<bigint>>, "
    "per_class_metrics map<string,struct<support:bigint,precision:double,recall:double>>"
)


def save_benchmark(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def load_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Stored results, projected to the six reported columns."""
    from siftwire.operators.log_analytics import model_benchmarks

    return model_benchmarks(spark.read.schema(RESULT_SCHEMA).json(path))


def model_registry(spark: SparkSession, root: str) -> DataFrame:
    """Names of the model folders that hold a card, sorted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    name = F.regexp_extract("path", r"/([^/]+)/metadata\.json(?:/|$)", 1)
    return files.select(name.alias("model_name")).filter(F.col("model_name") != "").distinct().orderBy("model_name")


def save_vectorizer(vocabulary: DataFrame, options, root: str, name: str) -> str:
    """Vocabulary and settings under one name."""
    from dataclasses import asdict

    path = f"{root.rstrip('/')}/{name}"
    vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    values = {k: repr(v) for k, v in asdict(options).items()}
    vocabulary.sparkSession.createDataFrame([(values,)], "options map<string,string>").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{path}/options")
    return path


def load_vectorizer(spark: SparkSession, root: str, name: str):
    from ast import literal_eval

    from siftwire.operators.features import TfidfOptions

    path = f"{root.rstrip('/')}/{name}"
    try:
        stored = spark.read.schema("options map<string,string>").json(f"{path}/options").first()
        vocabulary = spark.read.parquet(f"{path}/vocabulary")
    except Exception as error:
        raise FileNotFoundError(f"no vectorizer under {path}") from error
    return vocabulary, TfidfOptions(**{k: literal_eval(v) for k, v in stored["options"].items()})
