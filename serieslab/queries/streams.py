"""Windows, sessions and a stream over ``events``."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.queries.registry import query
from serieslab.session import shared_folder, table
from serieslab.streaming import commit, ingest


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    out = ingest.tumbling(table(spark, d, "events"), "ts", "1 hour", "event_type")
    return out.select(F.col("start").cast("timestamp_ntz"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY user_id, k""")
def session_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that end after six idle hours."""
    return ingest.sessions(table(spark, d, "events"), "ts", "6 hours", "user_id")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_dedup_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events read as a stream of files, repeated deliveries dropped, counted by an available-now run."""
    run = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, d, "events")
    source.unionByName(source.filter("event_id % 5 = 0")).write.parquet(f"{run}/in")
    stream = ingest.dedup(ingest.poll(spark, f"{run}/in", source.schema), ["event_id"], "ts", "365 days")
    sink = stream.select("event_id", "event_type", "value").writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start()
    sink.awaitTermination()
    return spark.read.parquet(f"{run}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), u AS (SELECT DISTINCT t, length(t) AS n FROM t)
SELECT 'files' AS name, count(*) AS n FROM t UNION ALL SELECT 'reports', count(*) FROM u WHERE n % 2 = 0 UNION ALL SELECT 'persons', count(DISTINCT n) FROM u WHERE n % 2 = 0
UNION ALL SELECT 'tests', 2 * count(*) FROM u WHERE n % 2 = 0 UNION ALL SELECT 'pending', count(*) FROM u WHERE n % 2 = 1""")
def ingest_stream_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the five tables after documents came as a stream of files in two batches, copies among them."""
    run = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size, sha = F.length("text"), F.sha1("text")
    tests = F.array(*(F.struct(F.lit(n).alias("name"), (size * k).cast("double").alias("value"), F.lit("mg/dL").alias("unit")) for n, k in (("Glucosa", 1), ("Urea", 2))))
    rows = docs.select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), sha.alias("sha1"), F.lit(0).alias("part"), sha.alias("lab"), F.lit("2024-01-01").cast("date").alias("date"), F.lit("ANA PEREZ").alias("name"), F.when(size % 2 == 0, F.lpad(size.cast("string"), 8, "0")).alias("doc"), tests.alias("tests"))
    for k in range(2):  # a run for the files that have come since the last one; each is written by many tasks
        rows.filter(F.pmod(F.xxhash64("path"), F.lit(2)) == k).write.mode("append").parquet(f"{run}/in")
        commit.ingest_stream(ingest.poll(spark, f"{run}/in", rows.schema), f"{run}/tables", f"{run}/state").awaitTermination()
    tables = commit.Tables(spark, f"{run}/tables", commit.TABLES)
    counts = [tables.read(t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")) for t in commit.TABLES]
    return reduce(DataFrame.unionByName, counts)
