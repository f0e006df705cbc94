"""Intake of files and reports, pages as words, and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from serieslab.functions import dates, numbers, text
from serieslab.operators import dedup, series
from serieslab.plans import ingest, layout
from serieslab.queries.registry import query
from serieslab.session import table


@query("""WITH d AS (SELECT c_custkey::VARCHAR AS key, ['approve', 'rename', 'cancel', 'existing', 'current'][c_custkey % 5 + 1] AS action, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS target, c_custkey % 4 <> 0 AS staged, c_name FROM customer),
o AS (SELECT *, CASE WHEN NOT staged THEN 'not_found' WHEN action = 'cancel' THEN 'cancelled' WHEN action IN ('existing', 'current') AND target IS NULL THEN 'error' ELSE action END AS outcome FROM d),
n AS (SELECT key, 1000000 + row_number() OVER (ORDER BY key) AS new FROM o WHERE outcome IN ('approve', 'rename'))
SELECT key, outcome, CASE WHEN outcome IN ('approve', 'rename', 'existing', 'current') THEN coalesce(new, target) END AS person_id, CASE WHEN outcome = 'approve' THEN c_name WHEN outcome = 'rename' THEN 'N ' || key END AS person_name FROM o LEFT JOIN n USING (key)""")
def decisions_applied(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on staged reports, with new persons numbered in the order of key."""
    c = table(spark, d, "customer").withColumn("key", F.col("c_custkey").cast("string"))
    actions = F.array(*map(F.lit, ("approve", "rename", "cancel", "existing", "current")))
    action = F.element_at(actions, (F.col("c_custkey") % 5 + 1).cast("int"))
    decisions = c.select("key", action.alias("action"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).cast("long").alias("target_id"), F.when(action == "rename", F.concat(F.lit("N "), "key")).alias("name"))
    pending = c.filter("c_custkey % 4 <> 0").select("key", F.col("c_name").alias("patient_name"), F.lit("").alias("doc"))
    persons = spark.createDataFrame([(1_000_000,)], "id long")
    return ingest.decide(pending, decisions, persons).select("key", "outcome", "person_id", "person_name")


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 2 = 1 THEN event_type END, first_value(CASE WHEN event_id % 2 = 1 THEN event_type END) OVER (PARTITION BY user_id ORDER BY event_id)) AS name FROM events""")
def carried_patient(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a file without a name take that of its first part."""
    e = table(spark, d, "events")
    own = F.when(F.col("event_id") % 2 == 1, F.col("event_type"))
    parts = e.select("event_id", F.col("user_id").alias("file_hash"), F.col("event_id").alias("part"), F.col("ts").alias("date"), own.alias("name"), F.lit("").alias("doc"))
    return ingest.carry_patient(parts).select("event_id", "name")


@query("""SELECT user_id AS person_id, count(*) FILTER (WHERE event_type <> 'error') AS n_ok, count(*) FILTER (WHERE event_type = 'error') AS n_errors, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'view' THEN 0 END), 0)::BIGINT AS new_reports FROM events GROUP BY 1""")
def upload_totals(spark: SparkSession, d: str) -> DataFrame:
    """Files, failures and new reports of each person's uploads."""
    return ingest.upload_summary(_uploads(spark, d))


@query("""SELECT event_id FROM events WHERE event_type NOT IN ('purchase', 'click')""")
def attachments_kept(spark: SparkSession, d: str) -> DataFrame:
    """Uploads kept as attachments: no report came of them and they are not known."""
    return ingest.attachments(_uploads(spark, d)).select("event_id")


def _uploads(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "click", "duplicate").otherwise("ok")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("person_id"), status.alias("status"), F.when(kind == "purchase", 2).when(kind == "view", 0).alias("new_reports"))


@query("""SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND NOT (doc_id % 2 = 0 AND doc_id % 6 = 0)""")
def studies_to_analyse(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a finished analysis and not read as a report."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 7).alias("person_id"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("stored_path"), F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("image").alias("kind"))
    analyses = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "done").otherwise("failed").alias("status"))
    return ingest.studies_to_analyse(docs, analyses, docs.filter("id % 6 = 0").select("person_id", "stored_path")).select("id")


@query("""WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN (1000000 + c_custkey)::VARCHAR ELSE '' END AS doc FROM customer WHERE c_custkey % 3 <> 0)
SELECT c_custkey AS doc, (1000000 + c_custkey)::VARCHAR AS entity, p.id AS person_id FROM customer JOIN p ON p.doc = (1000000 + c_custkey)::VARCHAR
UNION ALL SELECT c_custkey, translate(n_name, '_0123456789', ' ABCDEFGHIJ'), (SELECT min(c_custkey) FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c_custkey % 3 = 0) FROM customer JOIN nation n ON c_nationkey = n_nationkey WHERE n_nationkey >= 10 AND (SELECT min(c_custkey) FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c_custkey % 3 = 0) IS NOT NULL""")
def entity_persons(spark: SparkSession, d: str) -> DataFrame:
    """Persons found in texts by document number or by a name in capitals."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("n_name", F.translate("n_name", "_0123456789", " ABCDEFGHIJ"))
    number = (F.col("c_custkey") + 1_000_000).cast("string")
    texts = c.select(F.col("c_custkey").alias("doc"), F.concat(F.lit("Paciente: "), "n_name", F.lit(", CI "), number, F.lit(" otra vez "), number).alias("text"))
    by_doc = F.when((F.col("c_custkey") % 3 != 0) & (F.col("c_custkey") % 2 == 0), number).otherwise("")
    persons = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.initcap("n_name")).otherwise("").alias("name"), by_doc.alias("doc"))
    return ingest.entity_persons(texts, "doc", "text", persons)


@query("""WITH t AS (SELECT l_orderkey AS report_id, count(*) AS n_tests, count(CASE WHEN l_linenumber > 1 THEN l_quantity END) AS n_values FROM lineitem GROUP BY 1)
SELECT c_custkey AS id, count(o_orderkey) AS n_reports, coalesce(sum(n_tests), 0)::BIGINT AS n_tests, coalesce(sum(n_values), 0)::BIGINT AS n_values, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS newest_report
FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN t ON o_orderkey = report_id GROUP BY 1""")
def person_detail(spark: SparkSession, d: str) -> DataFrame:
    """Each customer with their orders as reports and the items as tests."""
    reports = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person_id"), F.col("o_orderdate").alias("date"))
    tests = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).alias("value"))
    return ingest.person_detail(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), reports, tests)


@query("""SELECT doc_id, regexp_replace(replace(text, chr(65533), ''), '[ \\t]+', ' ', 'g') AS cleaned, trim(text, ' ')[:24000] AS shown FROM documents""")
def cleaned_texts(spark: SparkSession, d: str) -> DataFrame:
    """Blanks squeezed, broken characters dropped; and texts cut to what a model may be sent."""
    return table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"), text.capped(F.col("text")).alias("shown"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(trim(p_name)), '[^a-záéíóúñ]+', ' ', 'g')) AS qualifier, 'otro:' || replace(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')), ' ', '_') AS key FROM part""")
def analyte_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of qualitative results and of analytes that no synonym knows."""
    return table(spark, d, "part").select("p_partkey", text.norm_qualifier(F.col("p_name")).alias("qualifier"), text.fallback_key(F.col("p_type")).alias("key"))


@query("""SELECT event_id, sha1(event_id::VARCHAR)[:12] || '_f' || event_id || '.pdf' AS name, 'p/' || user_id AS path, event_id || '|' || event_type || '|' || CASE WHEN event_id % 3 = 0 THEN 'None' ELSE strftime(ts, '%Y-%m-%d') END AS key FROM events""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of content-addressed copies, relative paths and report keys."""
    e = table(spark, d, "events")
    number = F.col("event_id").cast("string")
    day = F.when(F.col("event_id") % 3 != 0, F.date_format("ts", "yyyy-MM-dd"))
    path = F.concat(F.lit("/srv/data/p/"), F.col("user_id").cast("string"))
    return e.select("event_id", text.library_name(F.sha1(number), F.concat(F.lit("f"), number, F.lit(".pdf"))).alias("name"), text.relative_path(path).alias("path"), text.report_key(number, F.col("event_type"), day).alias("key"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, least(o_orderdate::DATE, (o_orderdate + INTERVAL 40 DAY)::DATE) AS earliest, (o_orderkey % 90)::INT AS age, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS plain, floor(epoch_us(TIMESTAMP '1999-01-01 06:00:00' - o_orderdate::TIMESTAMP) / 86400000000.0)::BIGINT AS days FROM orders""")
def date_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of dates: ISO, the earliest of several, an age, days between."""
    o = table(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp_ntz"))
    shown = lambda c: F.date_format(c, "d/M/yyyy")
    texts = F.concat(F.lit("entrega "), shown(F.expr("at + INTERVAL 40 DAYS")), F.lit(" ingreso "), shown("at"))
    age = F.concat(F.lit("Edad: "), (F.col("o_orderkey") % 90).cast("string"), F.lit(" años"))
    stamp = F.concat(dates.iso(F.col("at")), F.lit(".123"))
    late = F.lit("1999-01-01 06:00:00").cast("timestamp_ntz")
    return o.select("o_orderkey", dates.iso(F.col("at")).alias("iso"), dates.earliest_date(texts).alias("earliest"), dates.parse_age(age).alias("age"), dates.day_text(stamp).alias("day"), dates.plain_timestamp(stamp).alias("plain"), dates.whole_days(late, F.col("at")).cast("long").alias("days"))


@query("""SELECT l_orderkey, l_linenumber, 'Rango deseado: ' || CASE l_linenumber % 3 WHEN 0 THEN l_quantity::INT || ' – ' || (l_quantity + 5)::INT WHEN 1 THEN 'inferior a ' || (l_quantity + 5)::INT ELSE 'superior a ' || l_quantity::INT END || ' mg' AS tooltip, round(l_quantity / 2.89, 1) AS bmi, 'mg/dL' AS unit FROM lineitem""")
def range_texts(spark: SparkSession, d: str) -> DataFrame:
    """How reference ranges read, body mass indexes, and units that a range leaked into."""
    li, q = table(spark, d, "lineitem"), F.col("l_quantity")
    low, high = F.when(F.col("l_linenumber") % 3 != 1, q), F.when(F.col("l_linenumber") % 3 != 2, q + 5)
    leaked = F.concat(F.lit("deseable hasta "), q.cast("string"), F.lit(" md/dL"))
    return li.select("l_orderkey", "l_linenumber", numbers.range_tooltip(F.lit("-"), low, high, F.lit("mg")).alias("tooltip"), numbers.bmi(q, F.lit(170.0)).alias("bmi"), numbers.clean_unit(leaked).alias("unit"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, pos, last_value(CASE WHEN length(line) < 40 THEN pos END IGNORE NULLS) OVER w AS heading, length(lead(line) OVER (PARTITION BY doc_id ORDER BY pos)) AS next_length, length(lag(line) OVER (PARTITION BY doc_id ORDER BY pos)) AS previous_length
FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def lines_in_context(spark: SparkSession, d: str) -> DataFrame:
    """Lines with the short line above that they are under, and the lengths of their neighbours."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = series.carry_forward(lines, "doc_id", ["pos"], F.when(F.length("line") < 40, F.col("pos")), "heading")
    out = lines.withColumn("next_length", F.length(series.next_line("doc_id", ["pos"], F.col("line")))).withColumn("previous_length", F.length(series.previous_line("doc_id", ["pos"], F.col("line"))))
    return out.select("doc_id", F.col("pos").cast("long"), F.col("heading").cast("long"), F.col("next_length").cast("long"), F.col("previous_length").cast("long"))


@query("""SELECT user_id::VARCHAR AS doc, event_id AS line, event_type AS name, floor(value)::BIGINT::VARCHAR AS result, 'mg/dL' AS unit, 'a b' AS method, CASE WHEN event_id % 2 = 0 THEN '1 - 9' ELSE '' END AS reference FROM events""")
def page_rows(spark: SparkSession, d: str) -> DataFrame:
    """Words with places, put together to lines and columns of a layout."""
    _, ends = layout.bands("verdejo")
    w = lambda x, word: F.struct(F.lit(x).alias("x"), word.alias("word"))
    words = F.array(w(10.0, F.col("event_type")), w(210.0, F.floor("value").cast("string")), w(300.0, F.lit("mg/dL")), w(360.0, F.lit("b")), w(350.0, F.lit("a")))
    words = F.when(F.col("event_id") % 2 == 0, F.concat(words, F.array(w(460.0, F.lit("1 - 9"))))).otherwise(words)
    lined = table(spark, d, "events").select(F.col("user_id").cast("string").alias("doc"), F.lit(1).alias("page"), F.col("event_id").alias("line"), F.inline(words))
    return layout.table_rows(lined, ends).select("doc", "line", "name", "result", "unit", "method", "reference")


@query("""SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN 255 - g ELSE g END, 6) AS grey FROM (SELECT event_id, greatest(0.0, least(255.0, (value * 2 - 10 - (40 - 30)) / 60 * 255.0)) AS g FROM events)""")
def window_levels(spark: SparkSession, d: str) -> DataFrame:
    """Stored pixels rescaled, windowed, and turned round where low values are bright."""
    grey = dedup.window_scale(F.col("value"), F.lit(2.0), F.lit(-10.0), F.lit(40.0), F.lit(60.0), F.col("event_id") % 2 == 0)
    return table(spark, d, "events").select("event_id", F.round(grey, 6).alias("grey"))


@query("""WITH f AS (SELECT doc_id, 'p' || doc_id AS path, sha1(text) AS h FROM documents), known AS (SELECT path, h FROM f WHERE doc_id % 4 = 0),
fresh AS (SELECT h, min(doc_id) AS id FROM f WHERE h NOT IN (SELECT h FROM known) GROUP BY 1)
SELECT 'stored' AS t, count(*) FILTER (WHERE id % 2 = 0) AS n, coalesce(sum(id) FILTER (WHERE id % 2 = 0), 0)::BIGINT AS total FROM fresh
UNION ALL SELECT 'pending', count(*) FILTER (WHERE id % 2 = 1), coalesce(sum(id) FILTER (WHERE id % 2 = 1), 0)::BIGINT FROM fresh UNION ALL SELECT 'registry', count(*), sum(doc_id)::BIGINT FROM documents""")
def ingest_flow(spark: SparkSession, d: str) -> DataFrame:
    """Files, reports with and without a document, and the registry after a batch."""
    docs = table(spark, d, "documents")
    files = docs.select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.sha1("text").alias("sha1"), "doc_id")
    least = files.groupBy("sha1").agg(F.min("doc_id").alias("seq"))
    number = F.lpad(F.col("seq").cast("string"), 8, "0")
    reports = least.select(F.col("sha1").alias("file_hash"), F.lit(0).alias("part"), F.lit("Lab").alias("lab"), F.lit("2024-01-01").cast("date").alias("date"), F.lit("ANA PEREZ").alias("name"), F.when(F.col("seq") % 2 == 0, number).alias("doc"), "seq")
    stored = spark.createDataFrame([], "key string, person_id long, date date, lab string")
    persons = spark.createDataFrame([(1, "JUAN GOMEZ LOPEZ", "x")], "id long, name string, doc string")
    out = ingest.ingest_flow(files.select("path", "sha1"), files.filter("doc_id % 4 = 0").select("path", "sha1"), reports, persons, stored)
    total = lambda df, name, c: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("total")).select(F.lit(name).alias("t"), "n", "total")
    pending = out["pending"].join(least.withColumn("key", F.concat_ws("|", "sha1", F.lit("Lab"), F.lit("2024-01-01"))), "key")
    return total(out["stored"], "stored", "seq").unionByName(total(pending, "pending", "seq")).unionByName(total(out["registry"].withColumn("id", F.substring("path", 2, 20).cast("long")), "registry", "id"))


@query("""WITH c AS (SELECT c_custkey, (1000000 + c_custkey)::VARCHAR AS doc FROM customer), n AS (SELECT doc, (SELECT max(c_custkey) FROM c WHERE c_custkey % 2 = 0) + row_number() OVER (ORDER BY doc) AS new FROM c WHERE c_custkey % 2 = 1)
SELECT c_custkey, coalesce(new, c_custkey) AS person_id, new IS NOT NULL AS created FROM c LEFT JOIN n USING (doc)""")
def persons_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Reports of persons known by document, and new ones numbered after the largest known."""
    c = table(spark, d, "customer").select("c_custkey", F.lit("ANA PEREZ").alias("name"), (F.col("c_custkey") + 1_000_000).cast("string").alias("doc"))
    known = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("ROSA DIAZ").alias("name"), "doc")
    return ingest.resolve_persons(c, known).select("c_custkey", "person_id", "created")


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY lower(p_name), p_partkey) AS place FROM part""")
def readers_order(spark: SparkSession, d: str) -> DataFrame:
    """Names in the order of their readers, whatever their case."""
    shown = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    w = Window.partitionBy("p_size").orderBy(series.locale_order(shown), "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.row_number().over(w).cast("long").alias("place"))


# Given names and surnames that persons are called by here.
GIVEN, MIDDLE, LAST = ("ANA", "JOSÉ", "ÍÑIGO", "EVA", "LUZ"), ("PEÑA", "DÍAZ", "GÓMEZ", "RUIZ", "MEZA", "ALE", "VERA"), ("NÚÑEZ", "LÓPEZ", "ROMERO", "ORTIZ", "BÁEZ", "CANO", "DUARTE", "ESPÍNOLA", "FRANCO", "GILL", "HOLT")


@query("""WITH p AS (SELECT c_custkey AS id FROM customer), n AS (SELECT max(id) AS n FROM p),
found AS (SELECT c.id AS key, 1 AS kind, k AS pos, c.id + k AS person_id FROM p c, (VALUES (3), (5)) v(k), n WHERE c.id + k <= n AND (c.id + k) % 2 = 0
  UNION ALL SELECT c.id, 2, k, (c.id + k) % 385 FROM p c, (VALUES (1), (2), (4), (6), (8), (9)) v(k), n WHERE (c.id + k) % 385 <= n),
once AS (SELECT key, person_id, min(row(kind, pos)) AS h FROM found WHERE person_id <> key GROUP BY ALL)
SELECT key, place::INT AS place, person_id, CASE WHEN h[1] = 1 THEN 'documento' ELSE 'nombre' END AS match FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY h) AS place FROM once) WHERE place <= 5""")
def suggested_persons(spark: SparkSession, d: str) -> DataFrame:
    """Texts with numbers and names in capitals: a surname more, surnames turned round, a line break, accents, one token too few, more than five persons."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))

    def word(options: tuple, i: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, options)), (i % len(options) + 1).cast("int"))

    def name(i: Column, between: str = " ", turned: bool = False) -> Column:
        parts = [word(GIVEN, i), word(MIDDLE, i), word(LAST, i)]
        return F.concat_ws(between, *(parts[:1] + parts[1:][::-1] if turned else parts))

    k = F.col("id")
    number = lambda i: F.concat(F.lit("CI "), (i + 1_000_000).cast("string"))
    few = F.concat_ws(" ", word(GIVEN, k + 7), word(MIDDLE, k + 7))
    said = [name(k + 1), F.concat(name(k + 2), F.lit(" OVIEDO")), number(k + 3), name(k + 4, turned=True), number(k + 5), name(k + 6, "\n"), few, name(k + 8), name(k + 9)]
    texts = c.select(k.alias("key"), k.alias("person_id"), F.concat_ws(" visto con ", *said).alias("text"))
    persons = c.select("id", F.initcap(name(k)).alias("name"), F.when(k % 2 == 0, (k + 1_000_000).cast("string")).otherwise("").alias("doc"))
    return ingest.suggest_persons(texts, persons).select("key", "place", "person_id", "match")


@query("""WITH t AS (SELECT l_orderkey AS id, string_agg(l_linenumber || '=' || l_quantity::INT, ',' ORDER BY l_linenumber, l_quantity::INT) AS tests FROM lineitem GROUP BY 1),
r AS (SELECT o_custkey AS id, string_agg(o_orderkey || '(' || coalesce(tests, '') || ')', ' ' ORDER BY o_orderdate, o_orderkey) AS reports, max(o_orderdate)::DATE AS last FROM orders LEFT JOIN t ON o_orderkey = t.id GROUP BY 1),
m AS (SELECT user_id AS id, string_agg(event_id || event_type, ' ' ORDER BY event_id) AS medicines FROM events GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1),
d AS (SELECT c_custkey AS id, string_agg(doc_id || CASE WHEN doc_id % 2 = 0 AND r.id IS NOT NULL AND doc_id % 7 = 0 THEN '*' ELSE '' END || '/' || coalesce(n, 0), ' ' ORDER BY doc_id) AS documents, count(CASE WHEN DATE '1996-01-01' + doc_id::INT > last THEN 1 END) AS fresh
  FROM customer JOIN documents ON doc_id % 300 = c_custkey LEFT JOIN r ON r.id = c_custkey LEFT JOIN s USING (doc_id) GROUP BY 1)
SELECT c_custkey AS id, coalesce(reports, '') AS reports, coalesce(medicines, '') AS medicines, coalesce(documents, '') AS documents, coalesce(fresh, 0)::INT AS fresh, coalesce(fresh, 0) > 0 AS has_new, strftime(last, '%Y-%m-%d') AS last
FROM customer LEFT JOIN r ON r.id = c_custkey LEFT JOIN m ON m.id = c_custkey LEFT JOIN d ON d.id = c_custkey""")
def person_views(spark: SparkSession, d: str) -> DataFrame:
    """Everything of each customer: orders as reports with items as tests, events as medicines, documents with labels as analyses."""
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    reports = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person_id"), F.col("o_orderdate").alias("date"), F.lit("p0").alias("stored_path"))
    tests = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").cast("int").alias("value"))
    medicines = table(spark, d, "events").select(F.col("user_id").alias("person_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("name"))
    doc = F.col("doc_id")
    uploaded = F.concat(F.date_format(F.date_add(F.lit("1996-01-01").cast("date"), doc.cast("int")), "yyyy-MM-dd"), F.lit("T00:00:00.5"))
    documents = table(spark, d, "documents").select(doc.alias("id"), (doc % 300).alias("person_id"), F.when(doc % 2 == 0, "pdf").otherwise("image").alias("kind"), F.concat(F.lit("p"), (doc % 7).cast("string")).alias("stored_path"), uploaded.alias("uploaded_at"))
    analyses = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), F.lit("2024").alias("created_at"), "toxic")
    written = o.select(F.col("o_custkey").alias("person_id"), F.concat(day, F.lit(" 00:00:00")).alias("created_at"))
    out = ingest.person_view(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), reports, tests, medicines, documents, analyses, written)
    text = lambda c: c.cast("string")
    said = lambda c, f: F.array_join(F.transform(c, f), " ")
    report = lambda r: F.concat(text(r["id"]), F.lit("("), F.array_join(F.transform(r["tests"], lambda t: F.concat(text(t["pos"]), F.lit("="), text(t["value"]))), ","), F.lit(")"))
    document = lambda x: F.concat(text(x["id"]), F.when(x["is_parsed_lab"], "*").otherwise(""), F.lit("/"), text(F.size(x["analyses"])))
    return out.select("id", said("reports", report).alias("reports"), said("medicines", lambda m: F.concat(text(m["pos"]), m["name"])).alias("medicines"), said("documents", document).alias("documents"), F.col("new_info.count").alias("fresh"), F.col("new_info.has_new").alias("has_new"), F.left("new_info.last_report", F.lit(10)).alias("last"))
