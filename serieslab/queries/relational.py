"""Joins, aggregates and set operations of the store, and the built-in surface beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from serieslab.operators import dml, joins
from serieslab.queries.registry import query
from serieslab.session import table


@query("""SELECT c_custkey, c_name, count(DISTINCT o_orderkey) AS n_reports, count(l_linenumber) AS n_tests, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def person_report_stats(spark: SparkSession, d: str) -> DataFrame:
    """Persons with their numbers of reports and tests: both sides counted before they are joined, so nothing fans out."""
    tests = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("l_linenumber").alias("n"))
    reports = table(spark, d, "orders").join(tests, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey")
    stats = reports.agg(F.count(F.lit(1)).alias("n_reports"), F.sum("n").alias("n_tests"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"))
    out = table(spark, d, "customer").join(stats, F.col("c_custkey") == F.col("o_custkey"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("c_custkey", "c_name", zero("n_reports"), zero("n_tests"), "first_date", "last_date")


@query("SELECT l_orderkey, l_linenumber, l_quantity, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 7 ORDER BY o_orderdate, l_orderkey, l_linenumber")
def tests_for_person(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").filter("o_custkey = 7")
    rows = table(spark, d, "lineitem").join(own, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "o_orderdate").orderBy("o_orderdate", "l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey, sections FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS sections FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def report_sections(spark: SparkSession, d: str) -> DataFrame:
    sections = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("sections"))
    return table(spark, d, "orders").join(sections, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "sections")


@query("SELECT d.doc_id, lang, source, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def documents_with_analysis(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")


@query("SELECT d.doc_id, quality, n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def analyses_inner(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "quality", "n_chars")


@query("""WITH m AS (SELECT c_name AS k, c_custkey AS id FROM customer UNION ALL SELECT 'alias' || (c_custkey % 50), c_custkey FROM customer)
SELECT s_suppkey, 'alias' || s_suppkey AS k, min(id) AS id FROM supplier LEFT JOIN m ON m.k = 'alias' || s_suppkey GROUP BY 1, 2""")
def lookup_or_alias(spark: SparkSession, d: str) -> DataFrame:
    """Lookup by name or alias, the smallest id wins."""
    c = table(spark, d, "customer")
    names = c.select(F.col("c_name").alias("k"), F.col("c_custkey").alias("id"))
    aliases = c.select(F.concat(F.lit("alias"), (F.col("c_custkey") % 50).cast("string")).alias("k"), F.col("c_custkey").alias("id"))
    ids = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("alias"), F.col("s_suppkey").cast("string")).alias("k"))
    return joins.lookup(ids, "k", names, aliases)


@query("""SELECT person_id, max(t) AS newest FROM (SELECT o_custkey AS person_id, o_orderdate AS t FROM orders UNION ALL SELECT user_id, ts FROM events
UNION ALL SELECT o_custkey, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1""")
def newest_data_at(spark: SparkSession, d: str) -> DataFrame:
    orders, events = table(spark, d, "orders"), table(spark, d, "events")
    shipped = orders.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return dml.newest((orders, "o_custkey", "o_orderdate"), (events, "user_id", "ts"), (shipped, "o_custkey", "l_shipdate"))


@query("""WITH r AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), n AS (SELECT o_custkey, max(o_orderdate) AS newest FROM orders GROUP BY 1)
SELECT c_custkey FROM customer LEFT JOIN r ON r.o_custkey = c_custkey LEFT JOIN n ON n.o_custkey = c_custkey WHERE last IS NULL OR newest > last""")
def stale_reports(spark: SparkSession, d: str) -> DataFrame:
    """Persons whose last report (a finished order) is missing or older than their data."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("newest"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("last"))
    out = table(spark, d, "customer").join(o, "c_custkey", "left")
    return out.filter(dml.is_stale(F.col("newest"), F.col("last"))).select("c_custkey")


@query("""SELECT event_id, user_id FROM (SELECT *, max(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id) AS last FROM events) WHERE ts > last""")
def new_since_last(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    last = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("last"))
    return e.join(last, "user_id").filter("ts > last").select("event_id", "user_id")


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE lower(n_name) LIKE '%a%' OR c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def filters_surface(spark: SparkSession, d: str) -> DataFrame:
    """Conjunctions, disjunctions, containment without regard to case, and lists."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.filter(F.lower("n_name").contains("a") | F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n, grouping(l_returnflag)::BIGINT AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def grouping_sets_surface(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"), F.grouping("l_returnflag").cast("long").alias("g"))
    return out


@query("""SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS q FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)""")
def rank_surface(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal")
    tie = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(tie).cast("long").alias("q"))


@query("""(SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT c_nationkey, 'customer' FROM customer EXCEPT SELECT s_nationkey, 'customer' FROM supplier)""")
def set_ops_surface(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("customer")))


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)""")
def semi_anti_surface(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    few = c.join(o.filter("o_totalprice > 250000"), "c_custkey", "left_anti")
    has = o.filter("o_orderstatus = 'F'").select("c_custkey").distinct().withColumn("has", F.lit(True))
    return few.join(has, "c_custkey", "left").select("c_custkey", F.coalesce("has", F.lit(False)).alias("has"))
