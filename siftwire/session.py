"""Session helpers: sensible settings for stand-alone use and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def session(app: str = "siftwire", master: str | None = None, **conf) -> SparkSession:
    """Session with UTC times, adaptive execution and Arrow exchange."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="siftwire-")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names for checkpoints.

    Only a local session without the setting falls back to a folder of this machine.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    return _local_dir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"



def _folder(spark: SparkSession, path: str):
    """(file system, path) in whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def finished_parts(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of the folders ``path/prefix*`` whose writing job has committed, which Spark marks by a file in them."""
    store, target = _folder(spark, path)
    if not store.exists(target):
        return []
    names = sorted(s.getPath().getName() for s in store.listStatus(target) if s.isDirectory())
    mark = spark._jvm.org.apache.hadoop.fs.Path
    return [n for n in names if n.startswith(prefix) and store.exists(mark(f"{path}/{n}/_SUCCESS"))]


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` names a file, in whatever store it is."""
    store, target = _folder(spark, path)
    return store.exists(target) and store.getFileStatus(target).isFile()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote and nothing reads any more."""
    store, target = _folder(spark, path)
    store.delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts the lineage and outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
