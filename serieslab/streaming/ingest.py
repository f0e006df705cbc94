"""Polling, idempotent ingest and time windows as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType


def poll(spark: SparkSession, path: str, schema: StructType, per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream; the checkpoint remembers which were seen."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def poll_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """New files of a folder with their bytes."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def event_time(df: DataFrame, column: str, late: str = "10 minutes") -> DataFrame:
    """A stream with a watermark; event time has to be a timestamp with a zone."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def dedup(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first of events with equal keys within the watermark: repeated delivery has no effect."""
    return event_time(stream, time, late).dropDuplicatesWithinWatermark(keys)


def tumbling(df: DataFrame, time: str, width: str, *keys: str) -> DataFrame:
    """Counts and sums of ``value`` in windows of fixed width."""
    out = df.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, time: str, gap: str, *keys: str) -> DataFrame:
    """Runs of activity that end after an idle ``gap``."""
    out = df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    return out.drop("w")


def upsert_sink(stream: DataFrame, path: str, checkpoint: str, keys: list[str], seq: str, buckets: int = 64) -> StreamingQuery:
    """Keep a table at ``path`` with the last row of each key, whatever is delivered again; :func:`latest` reads it.

    Rows lie in buckets by a hash of their key. A batch writes the buckets that it touches as a new
    version, and then the list of which bucket is of which version; a batch that is run again starts from
    the list before it and writes the same. Versions that neither this list nor the one before names go.
    """
    from serieslab.operators.dml import upsert

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before, older = _versions(spark, path, number - 1), _versions(spark, path, number - 2)
        dealt = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = sorted(r[0] for r in dealt.select("_bucket").distinct().collect())
        own = [f"{path}/data/v{before[b]}/_bucket={b}" for b in touched if b in before]
        base = spark.read.schema(batch.schema).parquet(*own) if own else batch.limit(0)
        rows = upsert(base, dealt.drop("_bucket"), keys, seq).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/v{number}")
        after = before | dict.fromkeys(touched, number)
        spark.createDataFrame([(number, *x) for x in after.items()], VERSIONS).coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/v{number}")
        dealt.unpersist()
        for gone in [*(f"data/v{v}/_bucket={b}" for b, v in older.items() if before.get(b) != v), f"versions/v{number - 3}"]:
            target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{gone}")
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


VERSIONS = "number long, bucket int, version long"


def _versions(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """Version of each bucket after a batch; at most one row a bucket."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/v{number}")
    if number < 0 or not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.schema(VERSIONS).parquet(f"{path}/versions/v{number}").collect()}


def latest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table of :func:`upsert_sink` as of its last complete batch."""
    number = spark.read.schema(VERSIONS).parquet(f"{path}/versions/*").agg(F.max("number")).first()[0]
    return spark.read.schema(schema).parquet(*(f"{path}/data/v{v}/_bucket={b}" for b, v in _versions(spark, path, number).items()))


def idle_flush(stream: DataFrame, key: str, time: str, gap_seconds: int, late: str = "1 minute") -> DataFrame:
    """One row (key, n, first, last) when a key has been idle for ``gap_seconds`` of event time.

    Keeps a count and two times for each active key; the timer fires when the watermark has passed the
    last event by the gap, so it does not wait for another event of the key.
    """
    gap = gap_seconds * 1_000_000

    def row(group: tuple, n: int, first: int, last: int) -> pd.DataFrame:
        return pd.DataFrame({key: [group[0]], "n": [n], "first": pd.to_datetime([first], unit="us", utc=True), "last": pd.to_datetime([last], unit="us", utc=True)})

    def flush(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield row(group, *state.get)
            state.remove()
            return
        n, first, last = state.getOption or (0, 0, 0)
        for at in sorted(t for batch in batches for t in batch["_us"]):
            if n and at - last > gap:  # the key was idle before this event came
                yield row(group, n, first, last)
                n = 0
            n, first, last = n + 1, first if n else at, max(last, at) if n else at
        state.update((n, first, last))
        state.setTimeoutTimestamp(max((last + gap) // 1000, state.getCurrentWatermarkMs() + 1))

    timed = event_time(stream, time, late).withColumn("_us", F.unix_micros(time))
    kind = dict(stream.dtypes)[key]
    return timed.select(key, time, "_us").groupBy(key).applyInPandasWithState(flush, f"{key} {kind}, n long, first timestamp, last timestamp", "n long, first long, last long", "append", "EventTimeTimeout")
