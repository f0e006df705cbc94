"""Scalar functions over columns of the driver's tables; parsers are held to what was formatted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.functions import clinical, dates, numbers, text
from serieslab.queries.registry import query
from serieslab.session import table

KEY = ("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS v, l_quantity AS q FROM lineitem")
def parse_number_cases(spark: SparkSession, d: str) -> DataFrame:
    """Prices written in Spanish notation, read back."""
    li = table(spark, d, "lineitem")
    shown, count = numbers.es_number(F.col("l_extendedprice"), 2), numbers.es_number(F.col("l_quantity") * 1000, 0)
    return li.select(*KEY, numbers.parse_number(F.concat(F.lit("x "), shown, F.lit(" mg")), F.lit("")).alias("v"), (numbers.parse_number(count, F.lit("/µL")) / 1000).alias("q"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 1 THEN l_quantity WHEN l_linenumber % 3 = 0 THEN l_quantity END AS low, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity + 10 END AS high FROM lineitem")
def parse_range_cases(spark: SparkSession, d: str) -> DataFrame:
    """Ranges, upper and lower limits as texts, read back."""
    li = table(spark, d, "lineitem")
    low, high = (numbers.es_number(F.col("l_quantity") + x, 1) for x in (0, 10))
    shown = F.when(F.col("l_linenumber") % 3 == 1, F.concat(low, F.lit(" - "), high)).when(F.col("l_linenumber") % 3 == 2, F.concat(F.lit("Niños hasta 15 años: hasta "), high)).otherwise(F.concat(F.lit("Mayor a "), low))
    r = numbers.parse_range(shown, F.lit(""))
    return li.select(*KEY, r["low"].alias("low"), r["high"].alias("high"))


@query("SELECT o_orderkey, o_orderdate::TIMESTAMP AS at, strftime(o_orderdate, '%Y-%m-%d') AS birth, (datediff('day', o_orderdate, TIMESTAMP '2024-01-01') // 365)::BIGINT AS age FROM orders")
def parse_date_cases(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    shown = F.date_format("o_orderdate", "dd/MM/yyyy HH:mm")
    birth = dates.normal_birth(F.date_format("o_orderdate", "d-M-yyyy"))
    return o.select("o_orderkey", dates.parse_date(shown).alias("at"), birth.alias("birth"), dates.age_years(F.col("o_orderdate"), F.lit("2024-01-01").cast("date")).cast("long").alias("age"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_quantity * 1000 WHEN 1 THEN l_quantity * 1000000 ELSE l_quantity END AS v, CASE l_linenumber % 3 WHEN 2 THEN 'mg/dL' ELSE '/µL' END AS unit FROM lineitem""")
def normalize_units_cases(spark: SparkSession, d: str) -> DataFrame:
    unit = F.element_at(F.array(F.lit("10e3/µL"), F.lit("x10⁶/µL"), F.lit("mg/dL")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return table(spark, d, "lineitem").select(*KEY, numbers.to_common(F.col("l_quantity"), unit).alias("v"), numbers.common_unit(unit).alias("unit"))


@query("""SELECT l_orderkey, l_linenumber, translate(format('{:,.2f}', l_extendedprice), ',.', '.,') AS shown FROM lineitem""")
def format_es_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*KEY, numbers.es_number(F.col("l_extendedprice"), 2).alias("shown"))


@query("SELECT event_id, round(greatest(2.0, least(98.0, 18.0 + (value - 20) / 60 * 64)), 6) AS place FROM events")
def range_meter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(numbers.range_meter(F.col("value"), F.lit(20.0), F.lit(80.0)), 6).alias("place"))


@query("SELECT event_id, CASE WHEN value < 20 THEN 'L' WHEN value > 80 THEN 'H' ELSE 'N' END AS flag FROM events")
def flag_cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", clinical.flag(F.col("value"), F.lit(20.0), F.lit(80.0)).alias("flag"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, ['ene','feb','mar','abr','may','jun','jul','ago','sep','oct','nov','dic'][month(o_orderdate)] || ' ' || year(o_orderdate) AS label FROM orders")
def month_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", dates.month_key(F.col("o_orderdate")).alias("month"), dates.month_label(F.col("o_orderdate")).alias("label"))


@query("SELECT doc_id, crc32_, sha1(text) AS sha1, sha256(text) AS sha256 FROM (SELECT doc_id, text, length(text) AS crc32_ FROM documents)")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Digests of whole texts, with their lengths."""
    t = table(spark, d, "documents")
    return t.select("doc_id", F.length("text").cast("long").alias("crc32_"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query("""SELECT c_custkey, 'NAME' || c_custkey || ' CUSTOMER PEREZ' AS name, ['customer', 'perez', 'name' || c_custkey] AS t FROM customer""")
def person_names(spark: SparkSession, d: str) -> DataFrame:
    """``SURNAMES, GIVEN`` turned round, particles dropped, and the tokens that identify a person."""
    raw = F.concat(F.lit("Customer de Perez, name"), F.col("c_custkey").cast("string"))
    tokens = text.name_tokens(raw)
    return table(spark, d, "customer").select("c_custkey", text.person_name(raw).alias("name"), tokens.alias("t"))
