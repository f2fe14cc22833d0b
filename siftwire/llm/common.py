"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwire.session import drop_folder, scratch_path


#: Scratch tables of this process, in the order they were begun.
_BEGUN: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _BEGUN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freed(spark: SparkSession) -> Iterator[list[str]]:
    """Scratch tables begun in the block are removed at its end, but for those that it puts into the list it is given."""
    first, kept = len(_BEGUN), []
    yield kept
    for path in _BEGUN[first:]:
        if path not in kept:
            drop_folder(spark, path)
    _BEGUN[first:] = kept


def last_stored() -> str:
    """Path of the scratch table begun last."""
    return _BEGUN[-1]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def bytes_of(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column over the whole table."""
    return df.agg(F.sum(F.octet_length(column).cast("bigint"))).first()[0] or 0


def crc32_of_id(doc_id: str | Column) -> Column:
    """CRC-32 of the id as decimal text; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")))
