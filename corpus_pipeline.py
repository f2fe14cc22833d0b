"""Training corpus from the documents table: toxicity, near duplicates, benchmark passages, personal data, tokens.

Every stage reads what the stage before it wrote; all but the last return the columns of documents, whatever else these
hold and however it is named. An empty table passes through. Rows without an id stay in as long as nothing but their text
speaks against them; a null text is judged like an empty one, and stays null. No text is too long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwire.llm import bpe, decontaminate, pii, simhash, toxicity
from siftwire.llm.common import freed, last_stored, stored, table
from siftwire.session import drop_folder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from ``labels`` and the given documents.

    Every row is judged on its own text, so repeated rows share their fate. Texts without words have the score of such texts.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that fingerprints of four-word shingles link within four bits.

    Texts without words are one group. An id sorts before a missing one; rows that repeat the kept id and fingerprint are one.
    """
    return simhash.drop_near_duplicates(docs, width=4, threshold=4)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a twentieth or more of their words in windows of ``benchmark``.

    Rows that share an id go together; rows without an id, and without words, stay.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data; ``n_chars`` follows the new text and is null for a null one."""
    done = pii.pseudonymize(docs, pii.key_of(spark), values=None)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row, and the digests of the ids and of what they decode to; a null or empty text has no ids."""
    ids = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    return bpe.decode(ids, RANKS).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_copies),
    ("personal_data", replace_personal_data),
    ("tokens", encode_tokens),
]

#: Learned models, fingerprints and keyed permutations are not SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read by the next.

    What a stage leaves in the shared folder beside its result goes with it, and so does a result that the next stage has read.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with freed(spark) as kept:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(last_stored())
        if before:
            drop_folder(spark, before)
        before = kept[0]
    return docs
