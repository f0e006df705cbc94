"""Pages and texts: links, kinds, layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.functions.text import detect_layout, extension, file_kind, norm_text, study_uid
from serieslab.queries.registry import query
from serieslab.session import table
from serieslab.sources.registry import page_links


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) - 1 AS pos FROM pages) SELECT page_id, href, min(pos) AS pos FROM l GROUP BY 1, 2""")
def html_link_extract(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages, each once, at its first place."""
    return page_links(table(spark, d, "pages"), "page_id", "html").select("page_id", "href", F.col("pos").cast("long"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '1.2.' || page_id WHEN 1 THEN 'a' || page_id WHEN 2 THEN page_id || '.9' END AS uid FROM pages""")
def url_study_uid(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    kind = F.col("page_id") % 4
    url = F.when(kind == 0, F.concat(F.lit("http://h/?x=1&study=1.2."), n)).when(kind == 1, F.concat(F.lit("http://h/?manage=a"), n)).when(kind == 2, F.concat(F.lit("http://h/study/"), n, F.lit(".9"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", study_uid(url).alias("uid"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'pdf' WHEN 2 THEN 'dicom' ELSE 'other' END AS kind, ['.jpg', '.pdf', '.dcm', ''][page_id % 4 + 1] AS ext FROM pages""")
def kind_from_extension(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("study.v2"), F.col("page_id").cast("string"), F.element_at(F.array(F.lit(".JPG"), F.lit(".pdf"), F.lit(".Dcm"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int")))
    plain = F.when(F.col("page_id") % 4 == 3, F.lit("README")).otherwise(name)
    return table(spark, d, "pages").select("page_id", file_kind(plain).alias("kind"), extension(plain).alias("ext"))


# Layouts to look for in the documents, in order.
LAYOUTS = (("spanish", (("que", "para"),)), ("french", (("dans",), ("avec",))), ("german", (("nicht", "und"),)))


@query("""WITH n AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, CASE WHEN contains(t, 'que') AND contains(t, 'para') THEN 'spanish' WHEN contains(t, 'dans') OR contains(t, 'avec') THEN 'french' WHEN contains(t, 'nicht') AND contains(t, 'und') THEN 'german' ELSE 'other' END AS layout FROM n""")
def format_detect(spark: SparkSession, d: str) -> DataFrame:
    """The first layout whose words a text holds."""
    return table(spark, d, "documents").select("doc_id", detect_layout(F.lower("text"), LAYOUTS, "other").alias("layout"))


@query("SELECT source, max(length(norm)) > 0 AS any_text FROM (SELECT source, regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') AS norm FROM documents) GROUP BY 1")
def norm_text_surface(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg((F.max(F.length(norm_text(F.col("text")))) > 0).alias("any_text"))
