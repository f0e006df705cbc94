"""The assessment over ``events`` as biomarker series: a user is a person, an event type a biomarker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab import rules
from serieslab.plans import assessment as plan
from serieslab.plans import reports
from serieslab.queries.registry import query
from serieslab.session import table

# Event type, the key it stands for, and how its value becomes a measurement.
SERIES = (("click", "glucose", 60.0, 1.0), ("view", "ldl", 0.0, 2.0), ("purchase", "potassium", 3.0, 0.05), ("error", "crp", 0.0, 0.2), ("signup", "hemoglobin", 8.0, 0.1))
#: A month of events is too short for a year's ageing.
AGED_DAYS = 7


def tests(spark: SparkSession, d: str) -> DataFrame:
    """Events as rows of tests."""
    e = table(spark, d, "events")
    pick = lambda i: F.create_map(*(F.lit(x) for row in SERIES for x in (row[0], row[i])))[F.col("event_type")]
    none = lambda kind: F.lit(None).cast(kind)
    return e.select(F.col("user_id").alias("person_id"), F.col("event_id").alias("id"), pick(1).alias("key"), pick(1).alias("name"), F.col("ts").alias("date"), (pick(2) + F.col("value") * pick(3)).alias("value"), none("string").alias("qual"), F.lit("").alias("unit"), none("double").alias("ref_low"), none("double").alias("ref_high"))


def persons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("id")).distinct().withColumn("sex", F.when(F.col("id") % 2 == 0, "M").otherwise("F"))


def markers(spark: SparkSession, d: str) -> DataFrame:
    return plan.markers(tests(spark, d), persons(spark, d))


def findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings with the ageing rule at AGED_DAYS."""
    marked = markers(spark, d)
    newest = table(spark, d, "events").groupBy(F.col("user_id").alias("person_id")).agg(F.max("ts").alias("newest"))
    return plan.findings(marked, newest, AGED_DAYS)


MARKERS_SQL = """
dims(event_type, key, base, factor) AS (VALUES ('click','glucose',60.0::DOUBLE,1.0::DOUBLE), ('view','ldl',0.0,2.0), ('purchase','potassium',3.0,0.05), ('error','crp',0.0,0.2), ('signup','hemoglobin',8.0,0.1)),
ranges(key, sex, low, high) AS (VALUES ('glucose','M',70.0::DOUBLE,100.0::DOUBLE), ('glucose','F',70.0,100.0), ('ldl','M',0.0,100.0), ('ldl','F',0.0,100.0), ('potassium','M',3.5,5.1), ('potassium','F',3.5,5.1), ('crp','M',0.0,6.0), ('crp','F',0.0,6.0), ('hemoglobin','M',13.5,17.5), ('hemoglobin','F',12.0,16.0)),
critical(key, ch, cl) AS (VALUES ('glucose',250.0::DOUBLE,45.0::DOUBLE), ('potassium',5.5,3.0), ('crp',10.0,NULL)),
units(key, unit) AS (VALUES ('glucose','mg/dL'), ('ldl','mg/dL'), ('potassium','mEq/L'), ('crp','mg/L'), ('hemoglobin','g/dL')),
tests AS (SELECT user_id, event_id, key, ts, base + value * factor AS value, CASE WHEN user_id % 2 = 0 THEN 'M' ELSE 'F' END AS sex FROM events JOIN dims USING (event_type)),
seq AS (SELECT *, lag(value) OVER w AS previous, count(*) OVER (PARTITION BY user_id, key) AS n,
               row_number() OVER (PARTITION BY user_id, key ORDER BY ts DESC, event_id DESC) AS r FROM tests WINDOW w AS (PARTITION BY user_id, key ORDER BY ts, event_id)),
last AS (SELECT seq.*, low, high, ch, cl, unit FROM seq JOIN ranges USING (key, sex) LEFT JOIN critical USING (key) JOIN units USING (key) WHERE r = 1),
spans AS (SELECT *, greatest(high - low, 0.3 * abs(low), 0.3 * abs(high), 1e-9) AS span FROM last),
markers AS (SELECT user_id AS person_id, key, value, unit, low, high, n, ts AS last_date, sex,
  CASE WHEN value < low THEN 'bajo' WHEN value > high THEN 'alto' ELSE 'normal' END AS status,
  CASE WHEN coalesce(value > ch, false) OR coalesce(value < cl, false) OR (value > high AND (value - high) / span > 0.6) OR (value < low AND (low - value) / span > 0.6) THEN 'red' ELSE 'yellow' END AS severity,
  CASE WHEN previous IS NULL THEN '' WHEN abs(value - previous) < 1e-9 THEN 'estable' WHEN value > previous THEN 'subiendo' ELSE 'bajando' END AS trend FROM spans),
newest AS (SELECT user_id AS person_id, max(ts) AS newest FROM events GROUP BY 1),
findings AS (SELECT * REPLACE (CASE WHEN aged AND severity = 'red' THEN 'yellow' ELSE severity END AS severity) FROM
  (SELECT m.*, floor(epoch_us(newest - last_date) / 86400000000.0) > 7 AS aged FROM markers m JOIN newest USING (person_id) WHERE status <> 'normal'))
"""
RANK_SQL = "CASE severity WHEN 'red' THEN 0 WHEN 'yellow' THEN 1 ELSE 2 END"


@query(f"WITH {MARKERS_SQL} SELECT person_id, key, round(value, 6) AS value, unit, low, high, n, last_date, sex, status, severity, trend FROM markers")
def latest_marker_status(spark: SparkSession, d: str) -> DataFrame:
    """Latest value of each series with range, status, severity and trend."""
    return markers(spark, d).drop("label").withColumn("value", F.round("value", 6))


@query(f"WITH {MARKERS_SQL} SELECT person_id, key, status, severity, aged, row_number() OVER (PARTITION BY person_id ORDER BY {RANK_SQL}, key) AS pos FROM findings")
def findings_ranked(spark: SparkSession, d: str) -> DataFrame:
    return plan.rank_findings(findings(spark, d)).select("person_id", "key", "status", "severity", "aged", F.col("pos").cast("long"))


@query(f"""WITH {MARKERS_SQL}, systems(ord, system, key) AS (VALUES (0,'metabolic','glucose'), (2,'cardiovascular','ldl'), (3,'renal','creatinine'), (14,'haematology','hemoglobin'), (18,'inflammation','crp'), (20,'electrolytes','potassium'))
SELECT person_id, system, CASE WHEN count(*) FILTER (WHERE status <> 'normal') > 0 THEN 'alterado' ELSE 'normal' END AS status,
       max(severity) FILTER (WHERE status <> 'normal') AS severity, count(*) FILTER (WHERE status <> 'normal') AS n_issues FROM markers JOIN systems USING (key) GROUP BY person_id, system""")
def system_rollup(spark: SparkSession, d: str) -> DataFrame:
    """State of each body system (one issue a system here, so mildest and gravest agree)."""
    return plan.roll_up(markers(spark, d), rules.systems(spark)).drop("text")


@query(f"""WITH {MARKERS_SQL} SELECT person_id, count(*) FILTER (WHERE severity = 'red') AS n_red, count(*) FILTER (WHERE severity = 'yellow') AS n_yellow, count(*) FILTER (WHERE aged) AS n_aged,
CASE WHEN count(*) FILTER (WHERE severity = 'red') > 0 THEN 'crítico' WHEN count(*) FILTER (WHERE severity = 'yellow') > 0 THEN 'precaución' ELSE 'favorable' END AS tone FROM findings GROUP BY person_id""")
def assessment_summary(spark: SparkSession, d: str) -> DataFrame:
    return plan.summary(findings(spark, d))


@query(f"""WITH {MARKERS_SQL}, own AS (
SELECT person_id, key, severity, CASE
  WHEN aged THEN [upper(key) || ' ALTERADO EN ANÁLISIS ANTERIOR']
  WHEN severity = 'red' AND key = 'potassium' AND value > 5.5 THEN ['POTASIO CRÍTICO']
  WHEN severity = 'red' THEN [upper(key) || ' ALTERADO — VALOR CRÍTICO']
  WHEN key = 'glucose' AND value >= 100 AND value < 126 THEN ['PREDIABETES', 'PERDER 5-7% DEL PESO', 'ESTADÍSTICA']
  WHEN key = 'glucose' THEN ['GLUCOSE ' || upper(status), 'ESTADÍSTICA']
  WHEN key = 'ldl' THEN ['LDL ELEVADO', 'ESTADÍSTICA']
  WHEN key = 'crp' THEN ['INFLAMACIÓN'] WHEN key = 'hemoglobin' THEN ['HEMOGLOBINA'] ELSE ['POTASIO'] END AS titles FROM findings)
SELECT person_id, {RANK_SQL} AS "group", key, unnest(titles) AS title FROM own
UNION ALL SELECT u, 2, '', t FROM (SELECT DISTINCT user_id AS u FROM events), (VALUES ('ACTIVIDAD FÍSICA'), ('ALIMENTACIÓN'), ('CONTROL ANUAL'), ('CONTROL DE PSA')) v(t) WHERE t <> 'CONTROL DE PSA' OR u % 2 = 0""")
def recommendation_expand(spark: SparkSession, d: str) -> DataFrame:
    """Advice for every finding, then for everybody."""
    return plan.recommendations(findings(spark, d), persons(spark, d)).select("person_id", "group", "key", "title")


def medicines(spark: SparkSession, d: str) -> DataFrame:
    """A medicine list for each customer: the part of a line stands for a medicine."""
    names = F.array(*map(F.lit, MEDICINES))
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return lines.groupBy(F.col("o_custkey").alias("person_id"), F.get(names, (F.col("l_partkey") % len(MEDICINES)).cast("int")).alias("name")).agg(F.min("l_partkey").alias("pos"))


# Medicines as they are entered.
MEDICINES = ("Ibuprofeno 400", "Warfarin", "Aspirina", "Metformin 850", "Enalapril", "Losartan", "Furosemida", "Digoxina", "Biotina", "Agua de mar")
MEDS_SQL = f"""names(i, name) AS (VALUES {", ".join(f"({i},'{n}')" for i, n in enumerate(MEDICINES))}),
drug(name, drug, drug_name, norm) AS (VALUES ('Ibuprofeno 400','ibuprofeno','Ibuprofeno (AINE)','ibuprofeno 400'), ('Warfarin','warfarin','Warfarina (anticoagulante)','warfarin'), ('Aspirina','aspirina','Aspirina (ácido acetilsalicílico)','aspirina'), ('Metformin 850','metformina','Metformina','metformin 850'), ('Enalapril','enalapril','Enalapril (IECA)','enalapril'), ('Losartan','losartan','Losartán (ARA-II)','losartan'), ('Furosemida','furosemida','Furosemida (diurético de asa)','furosemida'), ('Digoxina','digoxina','Digoxina','digoxina'), ('Biotina','biotina','Biotina (vitamina B7, suplemento)','biotina')),
meds AS (SELECT o_custkey AS person_id, name, min(l_partkey) AS pos FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN names ON l_partkey % 10 = i GROUP BY 1, 2)"""


@query(f"""WITH {MARKERS_SQL}, {MEDS_SQL}, effects(drug, test, direction, severity) AS (VALUES ('ibuprofeno','potassium','up','yellow'), ('metformina','glucose','down','green'), ('enalapril','potassium','up','yellow'), ('losartan','potassium','up','yellow'), ('furosemida','potassium','down','yellow'), ('digoxina','potassium','down','yellow'))
SELECT m.person_id, e.drug, e.test, e.direction, e.severity, k.status AS marker_status FROM meds m JOIN drug USING (name) JOIN effects e USING (drug) JOIN markers k ON k.person_id = m.person_id AND k.key = e.test
WHERE k.status <> 'normal' AND e.direction = CASE WHEN k.status = 'alto' THEN 'up' ELSE 'down' END""")
def drug_lab_checks(spark: SparkSession, d: str) -> DataFrame:
    """Effects of medicines on abnormal markers."""
    return plan.lab_checks(plan.resolved_medicines(medicines(spark, d)), markers(spark, d)).drop("drug_name")


@query(f"""WITH {MEDS_SQL}, known AS (SELECT person_id, pos, name, drug, drug_name, norm FROM meds JOIN drug USING (name)),
inter(drug, other, severity) AS (VALUES ('aspirina','warfarin','red'), ('warfarin','aspirina','red'), ('ibuprofeno','enalapril','yellow'), ('ibuprofeno','losartan','yellow'), ('ibuprofeno','aspirina','yellow'), ('ibuprofeno','furosemida','yellow'), ('ibuprofeno','warfarin','red'), ('furosemida','digoxina','red'), ('digoxina','furosemida','red'))
SELECT a.person_id, a.drug_name || ' + ' || b.drug_name AS drugs, i.severity FROM known a JOIN known b ON a.person_id = b.person_id AND a.pos < b.pos JOIN inter i ON i.drug = a.drug AND i.other = b.norm""")
def drug_drug_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Interactions between the medicines of a person, earlier to later."""
    return plan.drug_pairs(plan.resolved_medicines(medicines(spark, d)))


@query(f"WITH {MEDS_SQL} SELECT person_id, name FROM meds WHERE name NOT IN (SELECT name FROM drug)")
def unknown_items(spark: SparkSession, d: str) -> DataFrame:
    return plan.unknown_medicines(plan.resolved_medicines(medicines(spark, d)))


@query("""SELECT event_id AS document_id, 'k' AS system, json_extract_string(props, '$.k')::DOUBLE AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_findings_explode(spark: SparkSession, d: str) -> DataFrame:
    """Numeric findings of JSON texts: each event's property as a finding."""
    e = table(spark, d, "events")
    text = F.concat(F.lit('[{"system": "k", "text": "k.", "value": '), F.get_json_object("props", "$.k"), F.lit("}]"))
    return plan.imaging_findings(e.select(F.col("event_id").alias("document_id"), F.col("ts").alias("created_at"), text.alias("findings_json"))).select("document_id", "system", "value")


@query("""WITH turns AS (SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS saved, arg_min(text, turn) AS opening FROM conversations GROUP BY conv_id)
SELECT conv_id, coalesce(saved, left(opening, 100)) AS report, saved IS NULL AS is_local FROM turns""")
def ai_report_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The stored report (the last turn of the assistant), else a local text."""
    saved = F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn")))
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(saved.alias("saved"), F.min_by("text", "turn").alias("opening"))
    return turns.select("conv_id", F.coalesce("saved", F.left("opening", F.lit(100))).alias("report"), F.col("saved").isNull().alias("is_local"))


# Names of tests as laboratories write them, by event type, with the keys that they stand for.
NAMES = (("click", "Glucosa en ayunas", "glucose"), ("view", "COLESTEROL LDL", "ldl"), ("purchase", "Potasio", "potassium"), ("error", "Prueba desconocida", "otro:prueba_desconocida"), ("signup", "Hemoglobina", "hemoglobin"))


@query("""WITH n(event_type, key, other) AS (VALUES ('click','glucose','otro:glucosa_en_ayunas'), ('view','ldl','otro:colesterol_ldl'), ('purchase','potassium','otro:potasio'), ('error','otro:prueba_desconocida','otro:prueba_desconocida'), ('signup','hemoglobin','otro:hemoglobina'))
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN other ELSE key END AS key FROM events JOIN n USING (event_type)""")
def canonical_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of tests by name: equal, contained, unknown, and in sections of urine, which have none of blood."""
    name = F.create_map(*(F.lit(x) for row in NAMES for x in row[:2]))[F.col("event_type")]
    tests = table(spark, d, "events").select("event_id", name.alias("name"), F.lit("mg/dL").alias("unit"), F.when(F.col("event_id") % 5 == 0, "ORINA SIMPLE").otherwise("QUIMICA").alias("section"))
    return plan.canonical_keys(tests, spark).select("event_id", "key")


@query("""WITH t AS (SELECT user_id, event_id, 60 + value AS value, CASE event_id % 3 WHEN 0 THEN 80.0 WHEN 1 THEN 1.0 END::DOUBLE AS lo, CASE event_id % 3 WHEN 0 THEN 120.0 WHEN 1 THEN 2.0 END::DOUBLE AS hi, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'click')
SELECT user_id AS person_id, round(value, 6) AS value, CASE WHEN event_id % 3 = 0 THEN lo ELSE 70.0::DOUBLE END AS low, CASE WHEN event_id % 3 = 0 THEN hi ELSE 100.0::DOUBLE END AS high,
CASE WHEN value < CASE WHEN event_id % 3 = 0 THEN lo ELSE 70.0 END THEN 'bajo' WHEN value > CASE WHEN event_id % 3 = 0 THEN hi ELSE 100.0 END THEN 'alto' ELSE 'normal' END AS status FROM t WHERE r = 1""")
def own_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The laboratory's own range counts where it is believable, else the standard one."""
    own = tests(spark, d).filter("key = 'glucose'")
    limit = lambda believable, not_: F.when(F.col("id") % 3 == 0, believable).when(F.col("id") % 3 == 1, not_)
    own = own.withColumn("ref_low", limit(80.0, 1.0)).withColumn("ref_high", limit(120.0, 2.0))
    return plan.markers(own, persons(spark, d)).select("person_id", F.round("value", 6).alias("value"), "low", "high", "status")


@query("""WITH c AS (SELECT user_id, CASE WHEN value > 90 THEN 'red' WHEN value > 50 THEN 'yellow' ELSE 'green' END AS s FROM events)
SELECT user_id AS person_id, CASE WHEN bool_or(s = 'red') THEN 'red' WHEN bool_or(s = 'yellow') THEN 'yellow' ELSE 'green' END AS severity FROM c GROUP BY 1""")
def overall_severity(spark: SparkSession, d: str) -> DataFrame:
    """The gravest of several lists of checks."""
    grade = F.when(F.col("value") > 90, "red").when(F.col("value") > 50, "yellow").otherwise("green")
    checks = table(spark, d, "events").select(F.col("user_id").alias("person_id"), grade.alias("severity"), "event_id")
    return plan.overall_severity(checks.filter("event_id % 2 = 0"), checks.filter("event_id % 2 = 1"))


@query(f"""WITH {MARKERS_SQL}, short AS (SELECT *, rtrim(rtrim(translate(format('{{:,.3f}}', value), ',.', '.,'), '0'), ',') AS v, rtrim(rtrim(translate(format('{{:,.3f}}', low), ',.', '.,'), '0'), ',') AS lo, rtrim(rtrim(translate(format('{{:,.3f}}', high), ',.', '.,'), '0'), ',') AS hi FROM markers),
m AS (SELECT person_id, string_agg('- ' || key || ': ' || v || ' ' || unit || ' (ref: ' || lo || '-' || hi || ') -> ' || CASE status WHEN 'normal' THEN status ELSE upper(status) END || CASE WHEN trend <> '' THEN ' · tendencia: ' || trend ELSE '' END || ' (' || n || ' mediciones), última ' || strftime(last_date, '%Y-%m-%d'), chr(10) ORDER BY key) AS t FROM short GROUP BY 1)
SELECT person_id, 'ESTADO ACTUAL:' || chr(10) || t || chr(10) || chr(10) || 'MEDICAMENTOS:' || chr(10) || CASE WHEN person_id % 2 = 0 THEN '- Metformina 850 mg (cada día)' ELSE '- Ninguno registrado' END AS text FROM m""")
def writer_input(spark: SparkSession, d: str) -> DataFrame:
    """What the writer of a report is given: markers and medicines of each person."""
    marked, people = markers(spark, d), persons(spark, d).select(F.col("id").alias("person_id"))
    state = reports.section(marked, "state", reports.marker_line(marked), F.col("label"))
    taken = people.filter("person_id % 2 = 0").withColumn("name", F.lit("Metformina"))
    medicines = reports.section(taken, "medicines", reports.medicine_line(F.lit("850 mg"), F.lit("cada día")), F.col("name"))
    return reports.assembled(people, [(state, "state", "ESTADO ACTUAL", ""), (medicines, "medicines", "MEDICAMENTOS", reports.NO_MEDICINES)])


@query("""SELECT c_custkey AS person_id, CASE WHEN c_custkey % 4 = 0 OR (c_custkey % 4 = 1 AND c_custkey % 3 = 0) THEN 'old' WHEN c_custkey % 3 = 1 THEN 'new' WHEN c_custkey % 4 = 1 THEN 'old' END AS text,
CASE WHEN c_custkey % 4 = 0 THEN 'stored' WHEN c_custkey % 3 = 1 THEN 'written' WHEN c_custkey % 4 = 1 THEN 'stale' ELSE 'none' END AS source FROM customer""")
def report_read_through(spark: SparkSession, d: str) -> DataFrame:
    """Stored reports, newly written ones, and stale ones where writing failed."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("person_id"))
    at = F.when(F.col("person_id") % 4 == 0, "2024-01-02").when(F.col("person_id") % 4 == 1, "2023-01-01").cast("timestamp")
    stored = c.filter("person_id % 4 < 2").select("person_id", F.lit("old").alias("text"), at.alias("made_at"))
    written = c.filter("person_id % 3 < 2").select("person_id", F.when(F.col("person_id") % 3 == 1, "new").alias("text"))
    return reports.read_through(c.withColumn("newest", F.lit("2024-01-01").cast("timestamp")), stored, written)
