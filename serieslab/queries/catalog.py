"""The catalogue over ``part``: a part is a product, its name the active principle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.functions import numbers
from serieslab.functions.text import title_case
from serieslab.plans import catalog as plan
from serieslab.queries.registry import query
from serieslab.session import table


def products(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("generic"), F.concat("p_type", F.lit(" "), F.col("p_size").cast("string"), F.lit(" MG COMPRIMIDO")).alias("product"))


GROUP_SQL = """SELECT p_name AS key, arg_min(p_name, p_partkey) AS generic, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS brands,
  array_to_string(list_transform(list_sort(list_distinct(list(p_size)))[1:24], lambda x: x || ' mg'), '|') AS strengths FROM part GROUP BY p_name"""


@query(GROUP_SQL)
def catalog_group(spark: SparkSession, d: str) -> DataFrame:
    """Entries by active principle, with distinct brands and strengths in order."""
    return plan.group_products(products(spark, d)).select("key", "generic", F.array_join("brands", "|").alias("brands"), F.array_join("strengths", "|").alias("strengths"))


@query("SELECT count(*) AS n, count(*) AS n_dosed, sum(b)::BIGINT AS n_brands FROM (SELECT p_name, count(DISTINCT p_type) AS b FROM part GROUP BY 1)")
def catalog_stats(spark: SparkSession, d: str) -> DataFrame:
    return plan.statistics(plan.group_products(products(spark, d)))


@query("""SELECT key, matched_brand, tier, undosed FROM (SELECT DISTINCT p_name AS key, NULL::VARCHAR AS matched_brand, CASE WHEN p_name LIKE 'red%' THEN 1 ELSE 4 END AS tier, 0 AS undosed FROM part WHERE contains(p_name, 'red'))
ORDER BY undosed, tier, key LIMIT 12""")
def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve entries for a query, by tier."""
    return plan.search(plan.group_products(products(spark, d)), "Red").select("key", "matched_brand", "tier", "undosed")


@query("""WITH e AS (SELECT p_name AS key, list_sort(list_distinct(list(p_type)))[1:50] AS brands FROM part GROUP BY 1),
q AS (SELECT DISTINCT q FROM (SELECT lower(substr(w, i, n)) AS q FROM (SELECT unnest(string_split(p_name || ' ' || p_type, ' ')) AS w FROM part), (VALUES (1, 2), (1, 4), (2, 3), (1, 30)) v(i, n)) WHERE length(q) >= 2),
h AS (SELECT q, key, brands, CASE WHEN key = q THEN 0 WHEN starts_with(key, q) THEN 1 WHEN len(list_filter(brands, lambda b: starts_with(lower(b), q))) > 0 THEN 3 ELSE 4 END AS tier FROM e, q
  WHERE contains(key, q) OR len(list_filter(brands, lambda b: contains(lower(b), q))) > 0)
SELECT q AS query, place::INT AS place, key, list_filter(brands, lambda b: contains(lower(b), q))[1] AS matched_brand, tier FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier, key) AS place FROM h) WHERE place <= 12""")
def catalog_search_many(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve entries for each of many queries: words of names and brands, and pieces of them."""
    word = F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("w")
    cut = F.explode(F.array(*(F.substring("w", i, n) for i, n in ((1, 2), (1, 4), (2, 3), (1, 30))))).alias("q")
    asked = table(spark, d, "part").select(word).distinct().select(cut).select(F.lower("q").alias("query")).distinct()
    out = plan.search_many(plan.group_products(products(spark, d)), asked.select(F.col("query").alias("query_id"), "query"))
    return out.select(F.col("query_id").alias("query"), "place", "key", "matched_brand", "tier")


@query("SELECT p_partkey, p_size || ' mg' AS labels FROM part")
def strength_extract(spark: SparkSession, d: str) -> DataFrame:
    return products(spark, d).select(F.col("ord").alias("p_partkey"), F.array_join(numbers.strength_labels(F.col("product")), "|").alias("labels"))


@query("SELECT p_partkey, p_type AS brand, p_name AS base FROM part")
def brand_clean(spark: SparkSession, d: str) -> DataFrame:
    p = products(spark, d)
    salted = F.concat(F.lit("cloridrato de "), F.col("generic"), F.lit(" anhidro"))
    return p.select(F.col("ord").alias("p_partkey"), plan.brand_name(F.col("product")).alias("brand"), plan.base_principle(salted).alias("base"))


@query("SELECT p_partkey, upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) AS title FROM part")
def title_cased(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", title_case(F.upper("p_name")).alias("title"))


@query("""SELECT p_partkey, p_name AS match FROM part""")
def product_match(spark: SparkSession, d: str) -> DataFrame:
    """Products of another list, by the longest principle that their name contains."""
    named = table(spark, d, "part").select("p_partkey", F.concat(F.lit("Super "), F.initcap("p_name"), F.lit(" plus")).alias("product"))
    return plan.match_products(named, plan.group_products(products(spark, d))).select("p_partkey", "match")


@query("""SELECT key, n_alias FROM (SELECT DISTINCT p_name AS key, 1 + (p_name LIKE 'red%')::BIGINT AS n_alias FROM part)""")
def overlay_catalog(spark: SparkSession, d: str) -> DataFrame:
    """A list that names some entries by their principle and adds an alias."""
    base = plan.group_products(products(spark, d))
    extra = base.filter(F.col("key").startswith("red")).select(F.concat(F.lit("x"), F.col("key")).alias("key"), "generic", F.array(F.col("key"), F.concat(F.col("key"), F.lit(" x"))).alias("aliases"), F.array(F.lit("Brand")).alias("brands"), F.array().cast("array<string>").alias("strengths"))
    return plan.merge_overlay(base, extra).select("key", F.size("aliases").cast("long").alias("n_alias"))
