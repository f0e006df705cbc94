"""Joins by precedence, containment and shared tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.functions.text import norm_text
from serieslab.operators import joins
from serieslab.plans.assessment import sex_rank
from serieslab.plans.ingest import text_entities
from serieslab.queries.registry import query
from serieslab.session import stored, table

# Words of product names, in order, and codes for them.
WORDS = (("ring", "R"), ("red", "RED"), ("red ring", "RR"), ("gear", "G"), ("old gear", "OG"), ("rod", "ROD"), ("widget", "W"), ("blue", "B"))
WORDS_SQL = ", ".join(f"({i}, '{w}', '{c}')" for i, (w, c) in enumerate(WORDS))


def words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, w, c) for i, (w, c) in enumerate(WORDS)], "ord int, word string, code string")


@query("""WITH names AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS block, string_split(p_name || ' ' || lower(p_type), ' ') AS tokens FROM part)
SELECT a.p_name AS p_name_a, a.t AS type_a, b.p_name AS p_name_b, b.t AS type_b, len(list_intersect(a.tokens, b.tokens)) AS common
FROM (SELECT DISTINCT p_name, p_type AS t, split_part(p_name, ' ', 1) AS block, string_split(p_name || ' ' || lower(p_type), ' ') AS tokens FROM part) a
JOIN (SELECT DISTINCT p_name, p_type AS t, split_part(p_name, ' ', 1) AS block, string_split(p_name || ' ' || lower(p_type), ' ') AS tokens FROM part) b ON a.block = b.block
WHERE len(list_intersect(a.tokens, b.tokens)) >= 2""")
def fuzzy_match_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Names with an equal first word and two or more shared tokens."""
    names = table(spark, d, "part").select("p_name", F.col("p_type").alias("type")).distinct()
    names = names.withColumn("block", F.split_part("p_name", F.lit(" "), F.lit(1))).withColumn("tokens", F.split(F.concat("p_name", F.lit(" "), F.lower("type")), " "))
    return joins.shared_tokens(names, names, "block", "tokens", 2).select("p_name_a", "type_a", "p_name_b", "type_b", F.col("common").cast("long"))


@query("""WITH t AS (SELECT doc_id, text || ' CI ' || (1000000 + doc_id) || ' ANA MARIA PEREZ ' || (doc_id % 7) AS t FROM documents)
SELECT doc_id, unnest(list_distinct(list_concat(regexp_extract_all(t, '\\b([0-9]{6,8})\\b'), regexp_extract_all(t, '((?:[A-Z][A-Z]+ ){1,5}[A-Z][A-Z]+)')))) AS entity FROM t""")
def text_entity_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Identity numbers and names in capitals in texts, each once."""
    text = F.concat("text", F.lit(" CI "), (F.col("doc_id") + 1_000_000).cast("string"), F.lit(" ANA MARIA PEREZ "), (F.col("doc_id") % 7).cast("string"))
    found = text_entities(table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id", "text")
    return found.select("doc_id", "entity")


@query("""WITH r(ord, seg, sex, hi) AS (VALUES (0, 'BUILDING', 'M', 5000.0::DOUBLE), (1, 'BUILDING', 'F', 6000.0), (2, 'MACHINERY', NULL, 4000.0), (3, 'MACHINERY', 'F', 3000.0), (4, 'FURNITURE', 'F', 2000.0)),
c AS (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex FROM customer)
SELECT c_custkey, hi FROM (SELECT c_custkey, hi, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN r.sex = c.sex THEN 0 WHEN r.sex IS NULL THEN 1 ELSE 2 END, ord) AS n FROM c LEFT JOIN r ON seg = c_mktsegment) WHERE n = 1""")
def range_precedence_join(spark: SparkSession, d: str) -> DataFrame:
    """The range of the own sex, else of none, else the first."""
    dim = spark.createDataFrame([(0, "BUILDING", "M", 5000.0), (1, "BUILDING", "F", 6000.0), (2, "MACHINERY", None, 4000.0), (3, "MACHINERY", "F", 3000.0), (4, "FURNITURE", "F", 2000.0)], "ord int, c_mktsegment string, sex string, hi double")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F").alias("own"))
    return joins.by_precedence(c, dim, "c_mktsegment", sex_rank(F.col("own"))).select("c_custkey", F.col("best.hi").alias("hi"))


@query(f"""WITH w(ord, word, code) AS (VALUES {WORDS_SQL}) SELECT p_partkey, code FROM (SELECT p_partkey, code, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN word = p_name THEN 0 ELSE 1 END, length(word) DESC, ord) AS n
FROM part LEFT JOIN w ON contains(p_name, word)) WHERE n = 1""")
def longest_match_join(spark: SparkSession, d: str) -> DataFrame:
    """The longest word that a name contains, ties by order."""
    return joins.longest_contained(table(spark, d, "part"), "p_name", words(spark), "word", "code").select("p_partkey", F.col("match").alias("code"))


CATALOGUE_SQL = """WITH RECURSIVE catalogue AS (SELECT word, count(*) AS ord FROM (SELECT unnest(regexp_extract_all(text, '[a-zà-ÿ]{3,}')) AS word FROM documents) GROUP BY word),
names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-zà-ÿ]{3,}')) AS name FROM conversations),
pieces AS (SELECT DISTINCT name, substr(name, i::INT, n::INT) AS word FROM (SELECT name, i, unnest(range(3, length(name) - i + 2)) AS n FROM (SELECT name, unnest(range(1, length(name) - 1)) AS i FROM names)))"""


def catalogue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Names of conversations, and all words of documents as a catalogue, in the order of how rare they are."""
    words = lambda t: table(spark, d, t).select(F.explode(F.regexp_extract_all("text", F.lit("[a-zà-ÿ]{3,}"), F.lit(0))).alias("word"))
    listed = words("documents").groupBy("word").agg(F.count(F.lit(1)).alias("ord"))
    names = words("conversations").select(F.col("word").alias("name")).distinct()
    return stored(names, "names"), stored(listed, "catalogue")  # read several times, with texts of any size behind them


@query(CATALOGUE_SQL + """ SELECT n.name, m.word AS longest FROM names n LEFT JOIN (SELECT name, arg_min(c.word, (c.word <> name, -length(c.word), c.ord, c.word)) AS word FROM pieces p JOIN catalogue c USING (word) GROUP BY name) m USING (name)""")
def longest_of_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The longest word of a large catalogue in each name; of equal ones the rarest, then the first."""
    names, listed = catalogue(spark, d)
    listed = listed.withColumn("ord", F.struct("ord", "word"))
    return joins.longest_contained(names, "name", listed, "word", "word").select("name", F.col("match").alias("longest"))


@query(CATALOGUE_SQL + """, contains AS (SELECT p.name, c.word AS alias, c.ord FROM pieces p JOIN catalogue c USING (word) WHERE length(c.word) >= 5),
within AS (SELECT n.name, a.alias, a.ord FROM names n JOIN (SELECT DISTINCT word AS alias, ord, substr(word, i::INT, m::INT) AS piece FROM (SELECT word, ord, i, unnest(range(3, length(word) - i + 2)) AS m FROM (SELECT word, ord, unnest(range(1, length(word) - 1)) AS i FROM catalogue WHERE length(word) >= 5))) a ON a.piece = n.name),
same AS (SELECT name, word AS alias, ord FROM names JOIN catalogue ON name = word)
SELECT n.name, m.alias FROM names n LEFT JOIN (SELECT name, arg_min(alias, (alias <> name, ord, alias)) AS alias FROM (SELECT * FROM contains UNION ALL SELECT * FROM within UNION ALL SELECT * FROM same) GROUP BY name) m USING (name)""")
def alias_of_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The entry of a large catalogue that equals each name, else the rarest that contains it or is contained in it."""
    names, listed = catalogue(spark, d)
    listed = listed.select(F.col("word").alias("alias"), F.struct("ord", "word").alias("ord"))
    return joins.resolve_alias(names, "name", listed, "alias").select("name", F.col("match").alias("alias"))


@query(f"""WITH w(ord, word, code) AS (VALUES {WORDS_SQL}) SELECT p_partkey, code FROM (SELECT p_partkey, code, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN word = p_name THEN 0 ELSE 1 END, ord) AS n
FROM part LEFT JOIN w ON word = p_name OR (length(word) >= 4 AND (contains(p_name, word) OR contains(word, p_name)))) WHERE n = 1""")
def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    """By equal alias, else the first of four letters or more that contains or is contained."""
    aliases = words(spark).withColumnRenamed("word", "alias")
    return joins.resolve_alias(table(spark, d, "part"), "p_name", aliases, "code", least=4).select("p_partkey", F.col("match").alias("code"))


@query("""SELECT coalesce(b.p_partkey, e.p_partkey) AS p_partkey, coalesce(e.p_size, b.p_size) AS p_size, coalesce(e.p_brand, b.p_brand) AS p_brand FROM part b
FULL JOIN (SELECT p_partkey + 100 AS p_partkey, CASE WHEN p_size > 25 THEN p_size END AS p_size, 'X' AS p_brand FROM part WHERE p_partkey % 3 = 0) e ON b.p_partkey = e.p_partkey""")
def overlay_merge(spark: SparkSession, d: str) -> DataFrame:
    """Values of an overlay in the place of the base's, new entries added."""
    p = table(spark, d, "part")
    extra = p.filter("p_partkey % 3 = 0").select((F.col("p_partkey") + 100).alias("p_partkey"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size"), F.lit("X").alias("p_brand"))
    return joins.overlay(p, extra, "p_partkey", ["p_size", "p_brand"])


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE a.p_type = b.p_type) AS n_same FROM (SELECT l_orderkey, l_linenumber, p_type FROM lineitem JOIN part ON l_partkey = p_partkey) a
JOIN (SELECT l_orderkey, l_linenumber, p_type FROM lineitem JOIN part ON l_partkey = p_partkey) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber""")
def pairs_within_order(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pairs of lines of an order."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    pairs = joins.pairs_within(lines, "l_orderkey", "l_linenumber", ["p_type"])
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_type_a") == F.col("p_type_b")).alias("n_same"))


@query("SELECT doc_id, trim(regexp_replace(lower(regexp_replace(translate(text, 'áéíóúüñçèêàâîôûëïäöÁÉÍÓÚÜÑÇÈÊÀÄÖ', 'aeiouunceeaaioueiaoAEIOUUNCEEAAO'), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents")
def norm_text_all(spark: SparkSession, d: str) -> DataFrame:
    """Search keys of whole texts."""
    return table(spark, d, "documents").select("doc_id", norm_text(F.col("text")).alias("norm"))
