"""Ordered series: trends, picks, months, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.functions.clinical import trend
from serieslab.operators import dedup
from serieslab.operators import series as ops
from serieslab.plans.layout import text_blocks
from serieslab.queries.registry import query
from serieslab.session import table

#: Every month that orders may be of.
MONTHS = [f"{y}-{m:02d}" for y in range(1992, 2003) for m in range(1, 13)]


@query("""SELECT event_id, CASE WHEN lag(value) OVER w IS NULL THEN '' WHEN abs(value - lag(value) OVER w) < 1e-9 THEN 'estable' WHEN value > lag(value) OVER w THEN 'subiendo' ELSE 'bajando' END AS trend
FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def trend_lag(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", trend(F.col("value"), F.lag("value").over(w)).alias("trend"))


@query("""SELECT source, doc_id, pos, n FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE pos IN (1, n, n // 2 + 1)""")
def first_mid_last(spark: SparkSession, d: str) -> DataFrame:
    out = ops.first_middle_last(table(spark, d, "documents").select("source", "doc_id"), ["source"], F.col("doc_id"))
    return out.select("source", "doc_id", F.col("pos").cast("long"), "n")


@query("SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) AS value, max(o_orderdate) AS at FROM orders GROUP BY 1, 2")
def monthly_last(spark: SparkSession, d: str) -> DataFrame:
    return ops.monthly_last(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")


@query("WITH m AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) AS v FROM orders GROUP BY 1, 2) SELECT o_custkey, " + ", ".join(f"max(CASE WHEN month = '{m}' THEN v END) AS \"{m}\"" for m in MONTHS) + " FROM m GROUP BY 1")
def monthly_pivot(spark: SparkSession, d: str) -> DataFrame:
    return ops.monthly_pivot(monthly_last(spark, d), "o_custkey", MONTHS)


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT user_id, event_type, n, round(least(lo * 0.9, 0.0), 6) AS y_min, round(greatest(hi * 1.1, 100.0), 6) AS y_max FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS r FROM s) WHERE r <= 3""")
def chart_series(spark: SparkSession, d: str) -> DataFrame:
    """The first charts of each user with two points or more, with the range of their axis."""
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).filter("n >= 2")
    top = ops.top_per_group(s, ["user_id"], 3, F.col("event_type"))
    return top.select("user_id", "event_type", "n", F.round(F.least(F.col("lo") * 0.9, F.lit(0.0)), 6).alias("y_min"), F.round(F.greatest(F.col("hi") * 1.1, F.lit(100.0)), 6).alias("y_max"))


@query("SELECT doc_id, lang FROM documents ORDER BY lang, doc_id LIMIT 24 OFFSET 24")
def gallery_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a gallery of 24."""
    return ops.page(table(spark, d, "documents").select("doc_id", "lang"), 1, 24, F.col("lang"), F.col("doc_id"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
b AS (SELECT *, sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM l)
SELECT doc_id, block::BIGINT AS block, count(*) AS n_lines, min(pos) AS first_pos, count(nxt) AS n_next FROM b GROUP BY 1, 2""")
def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of lines: a line under 40 characters starts one."""
    rows = text_blocks(table(spark, d, "documents"), "doc_id", "text", F.length("line") < 40)
    return rows.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n_lines"), F.min("pos").cast("long").alias("first_pos"), F.count("next").alias("n_next"))


@query("""WITH RECURSIVE s AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
f(source, r, doc_id, n_chars, filled, chunk) AS (
  SELECT source, r, doc_id, n_chars, n_chars, 0::BIGINT FROM s WHERE r = 1
  UNION ALL SELECT s.source, s.r, s.doc_id, s.n_chars, CASE WHEN f.filled + s.n_chars > 20000 THEN s.n_chars ELSE f.filled + s.n_chars END, f.chunk + CASE WHEN f.filled + s.n_chars > 20000 THEN 1 ELSE 0 END
  FROM f JOIN s ON s.source = f.source AND s.r = f.r + 1)
SELECT source, doc_id, n_chars, chunk FROM f""")
def greedy_chunking(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source packed in order into chunks of 20,000 characters."""
    return dedup.greedy_chunks(table(spark, d, "documents"), "source", "doc_id", "n_chars", 20000)


@query("""WITH RECURSIVE s AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
f(label, r, vec_id, kept, last) AS (
  SELECT label, r, vec_id, true, embedding FROM s WHERE r = 1
  UNION ALL SELECT s.label, s.r, s.vec_id, d >= 0.14, CASE WHEN d >= 0.14 THEN s.embedding ELSE f.last END
  FROM f JOIN s ON s.label = f.label AND s.r = f.r + 1, LATERAL (SELECT list_sum(list_transform(list_zip(f.last, s.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) / len(f.last) AS d))
SELECT label, vec_id FROM f WHERE kept""")
def near_dup_last_kept(spark: SparkSession, d: str) -> DataFrame:
    """Signatures kept by a pass that drops those close to the last kept one."""
    return dedup.keep_unlike_last(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.14)
