"""Registries of medicines: national CSV, JSON lists, crawled pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A national registry: semicolons, Latin-1, a header. Active medicines only, with a row number as order."""
    raw = spark.read.csv(path, sep=";", encoding="ISO-8859-1", header=True)
    active = (F.upper(F.trim("TIPO_PRODUTO")) == "MEDICAMENTO") & (F.lower(F.trim("SITUACAO_REGISTRO")) == "ativo")
    return raw.filter(active).select(F.monotonically_increasing_id().alias("ord"), F.trim("NOME_PRODUTO").alias("product"), F.trim("PRINCIPIO_ATIVO").alias("generic"))


def read_list(spark: SparkSession, path: str, field: str = "medicines") -> DataFrame:
    """Rows of one JSON document's array ``field``, with their place."""
    doc = spark.read.json(path, multiLine=True)
    return doc.select(F.posexplode(field).alias("ord", "m")).select("ord", "m.*")


def links(html: Column, pattern: str = r'href="([^"]+)"') -> Column:
    """Targets of the links of a page in order."""
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def page_links(pages: DataFrame, key: str, html: str, pattern: str = r'href="([^"]+)"') -> DataFrame:
    """key, pos and href of each page's links; of equal ones the first stays."""
    rows = pages.select(key, F.posexplode(links(F.col(html), pattern)).alias("pos", "href"))
    return rows.groupBy(key, "href").agg(F.min("pos").alias("pos"))
