"""Sessions and tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` has further settings, dots written as double underscores."""
    builder = SparkSession.builder.appName("serieslab").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on one machine a temporary one, removed at exit, if that is unset, on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet in the shared folder and read again, so that later steps start from files and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_of(rows: int, most: int) -> int:
    """Tasks for so many rows, of at most ``most`` each on average: what a task holds stays the same when tables grow."""
    return -(-max(1, rows) // most)


def shared_folder_of(df: DataFrame, name: str, by: str) -> str:
    """A new folder with ``df`` as Parquet, in a folder of its own for each value of ``by``."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    return path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """From now on rows reach Python tasks in batches of about ``size`` bytes: files are large, and a batch of thousands would be held whole."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
