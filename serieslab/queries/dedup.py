"""Duplicates, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.operators import dedup as ops
from serieslab.operators import dml
from serieslab.queries.registry import query
from serieslab.session import table


@query("""SELECT doc_id, sha1(text) AS sha1, count(*) OVER (PARTITION BY text) AS copies, min(doc_id) OVER (PARTITION BY text) AS keep FROM documents""")
def exact_content_dedup(spark: SparkSession, d: str) -> DataFrame:
    return ops.content_groups(table(spark, d, "documents"), "text", "doc_id").select("doc_id", "sha1", "copies", "keep")


@query("""WITH f AS (SELECT doc_id, 'p' || doc_id AS path, sha1(text) AS h FROM documents), known AS (SELECT path, h FROM f WHERE doc_id % 4 = 0)
SELECT f.doc_id, CASE WHEN k.h = f.h THEN 'unchanged' WHEN f.h IN (SELECT h FROM known) THEN 'duplicate' WHEN row_number() OVER (PARTITION BY f.h ORDER BY f.path) > 1 THEN 'duplicate' ELSE 'new' END AS status
FROM f LEFT JOIN known k ON k.path = f.path""")
def file_registry_status(spark: SparkSession, d: str) -> DataFrame:
    """Files against a registry that has every fourth."""
    files = table(spark, d, "documents").select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.sha1("text").alias("sha1"))
    return ops.file_status(files, files.filter("doc_id % 4 = 0").select("path", "sha1")).select("doc_id", "status")


@query("""WITH r AS (SELECT event_id AS seq, user_id AS person_id, date_trunc('day', ts) AS date, event_type AS lab, user_id || '|' || event_type || '|' || strftime(ts, '%Y-%m-%d') AS key FROM events),
s AS (SELECT * FROM r WHERE seq % 10 = 0)
SELECT seq, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM r WHERE key NOT IN (SELECT key FROM s)) WHERE n = 1""")
def report_key_dedup(spark: SparkSession, d: str) -> DataFrame:
    """New reports by key, and by person, date and laboratory."""
    e = table(spark, d, "events")
    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd"))
    r = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("person_id"), F.date_trunc("day", F.col("ts")).alias("date"), F.col("event_type").alias("lab"), key.alias("key"))
    return ops.new_reports(r, r.filter("seq % 10 = 0")).select("seq", "key")


@query("""WITH n AS (SELECT o_orderkey, o_custkey, o_totalprice, 0 AS seq FROM orders UNION ALL SELECT o_orderkey + 7, o_custkey, o_totalprice * 2, 1 FROM orders WHERE o_orderkey % 5 = 0)
SELECT o_orderkey, o_custkey, o_totalprice, seq FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) AS r FROM n) WHERE r = 1""")
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    new = o.filter("o_orderkey % 5 = 0").select((F.col("o_orderkey") + 7).alias("o_orderkey"), "o_custkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit(1).alias("seq"))
    return dml.upsert(o.withColumn("seq", F.lit(0)), new, ["o_orderkey"], "seq")


@query("""WITH b AS (SELECT c_name, c_custkey FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT c_name, c_custkey + 1 AS c_custkey FROM customer UNION ALL SELECT c_name, c_custkey + 2 FROM customer)
SELECT * FROM b UNION ALL SELECT c_name, min(c_custkey) FROM n WHERE c_name NOT IN (SELECT c_name FROM b) GROUP BY c_name""")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_name", "c_custkey")
    new = c.withColumn("c_custkey", F.col("c_custkey") + 1).unionByName(c.withColumn("c_custkey", F.col("c_custkey") + 2))
    return dml.insert_or_ignore(c.filter("c_custkey % 3 = 0"), new, ["c_name"], F.col("c_custkey"))


@query("""SELECT 'orders' AS t, count(*) AS n FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Children left when every tenth customer goes."""
    o, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    gone = o.filter("o_custkey % 10 = 0")
    left_o, left_l = dml.delete_cascade(gone, "o_orderkey", (o, "o_orderkey"), (items, "l_orderkey"))
    count = lambda df, t: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n")
    return count(left_o, "orders").unionByName(count(left_l, "lineitem"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'new' ELSE c_mktsegment END AS seg FROM (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 4 = 0 AND c_acctbal >= 0 THEN 'filled' ELSE c_mktsegment END AS c_mktsegment FROM customer)""")
def conditional_fill(spark: SparkSession, d: str) -> DataFrame:
    """Blanks filled from a patch, and values that the patch overrides."""
    c = table(spark, d, "customer")
    base = c.select("c_custkey", F.when((F.col("c_custkey") % 4 == 0) & (F.col("c_acctbal") >= 0), "").otherwise(F.col("c_mktsegment")).alias("seg"))
    filled = dml.fill_missing(base, c.select("c_custkey", F.lit("filled").alias("seg")), "c_custkey", ["seg"])
    return dml.fill_missing(filled, c.select("c_custkey", F.when(F.col("c_acctbal") < 0, "new").alias("seg")), "c_custkey", [], ["seg"])


@query("""WITH f AS (SELECT doc_id, sha1(text) AS h, 'p' || doc_id AS path FROM documents)
SELECT doc_id FROM f WHERE NOT EXISTS (SELECT 1 FROM f r WHERE r.doc_id % 2 = 0 AND r.h = f.h) AND NOT EXISTS (SELECT 1 FROM labels l WHERE 'p' || l.doc_id = f.path)""")
def orphan_prune(spark: SparkSession, d: str) -> DataFrame:
    """Files that neither a report nor a document refers to."""
    files = table(spark, d, "documents").select("doc_id", F.sha1("text").alias("sha1"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"))
    reports = files.filter("doc_id % 2 = 0").select(F.concat("sha1", F.lit("|lab|2024")).alias("file_hash"))
    documents = table(spark, d, "labels").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("stored_path"))
    return dml.orphans(files, "sha1", "path", reports, "file_hash", documents, "stored_path").select("doc_id")


@query("SELECT doc_id, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id")
def backfill_missing(spark: SparkSession, d: str) -> DataFrame:
    return dml.backfill(table(spark, d, "labels"), table(spark, d, "documents"), ["doc_id"])


@query("""SELECT * FROM (SELECT a.vec_id // 16 AS study, a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) / 64, 6) AS diff
FROM embeddings a JOIN embeddings b ON a.vec_id // 16 = b.vec_id // 16 AND a.vec_id < b.vec_id) WHERE diff <= 0.14""")
def pairwise_signature_diff(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of alike signatures within studies of 16."""
    e = table(spark, d, "embeddings").withColumn("study", F.expr("vec_id div 16"))
    # what is compared is the rounded difference, so pairs are found with a limit that no rounding reaches
    return ops.pairs_below(e, "study", "vec_id", "embedding", 0.140001).withColumn("diff", F.round("diff", 6)).filter("diff <= 0.14")


@query("""SELECT min(doc_id) AS seq, doc_id % 50 AS person_id, sha1(text) AS sha1 FROM documents WHERE (doc_id % 50, sha1(text)) NOT IN (SELECT (doc_id % 50, sha1(text)) FROM documents WHERE doc_id % 3 = 0) GROUP BY 2, 3""")
def new_attachments(spark: SparkSession, d: str) -> DataFrame:
    """Files that a person doesn't have, where every third is stored."""
    files = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), (F.col("doc_id") % 50).alias("person_id"), F.sha1("text").alias("sha1"))
    return ops.new_attachments(files, files.filter("seq % 3 = 0"))


@query("""SELECT vec_id, (i // 8) AS block, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2""")
def block_mean(spark: SparkSession, d: str) -> DataFrame:
    out = ops.block_mean(table(spark, d, "embeddings"), "vec_id", "embedding", 8)
    return out.select("vec_id", F.col("block").cast("long"), F.round("mean", 6).alias("mean"))


@query("""WITH p AS (SELECT event_type, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM events GROUP BY 1)
SELECT event_id, round((least(greatest(value, lo), hi) - lo) / (hi - lo) * 255.0, 6) AS scaled FROM events JOIN p USING (event_type)""")
def percentile_scale(spark: SparkSession, d: str) -> DataFrame:
    return ops.percentile_scale(table(spark, d, "events"), "event_type", "value").select("event_id", F.round("scaled", 6).alias("scaled"))
