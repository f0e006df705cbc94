"""From rows of measurements to markers, findings, systems, recommendations, medicine checks and a summary.

Every step is one DataFrame over all persons. ``markers`` feeds the others; callers that use several of
them persist it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab import rules
from serieslab.functions import clinical
from serieslab.functions.dates import whole_days
from serieslab.functions.numbers import clean_unit
from serieslab.functions.text import fallback_key, norm_qualifier, norm_text
from serieslab.operators import joins, series
from serieslab.session import stored

#: A finding this many days older than the person's newest report is aged.
AGED_DAYS = 365


def sex_rank(sex: Column) -> callable:
    """Rank of a range: of the person's sex, else of no sex, else any."""
    return lambda c: F.when(c["sex"] == sex, 0).when(c["sex"].isNull(), 1).otherwise(2)


def canonical_keys(tests: DataFrame, spark: SparkSession) -> DataFrame:
    """``key`` of each test from its name, unit and section: a synonym, else a key made of its name.

    Urine sections have no keys of blood tests. Where the section or unit speaks of absolute counts the
    names of absolute counts come first. Else an equal synonym, else the longest of four or more
    letters that the name contains.
    """
    out = tests.withColumn("_name", norm_text(F.col("name"))).withColumn("_section", norm_text(F.coalesce("section", F.lit(""))))
    unit = F.lower(F.coalesce("unit", F.lit("")))
    absolute = F.col("_section").contains("absoluta") | unit.rlike("10e3|10e6|/ul|/µl")
    names = out.select("_name").distinct().filter("_name <> ''")
    counts = names.join(F.broadcast(rules.absolute_names(spark)), F.col("_name").contains(F.col("synonym")))
    counts = counts.groupBy("_name").agg(F.min_by("key", "ord").alias("_absolute"))
    words = joins.longest_contained(names, "_name", rules.synonyms(spark), "synonym", "key", least=4).withColumnRenamed("match", "_word")
    out = out.join(words, "_name", "left").join(counts, "_name", "left")
    known = F.when(F.col("_section").rlike("orina|sedimento|urina|chorro") | (F.col("_name") == ""), F.lit(None)).otherwise(F.coalesce(F.when(absolute, F.col("_absolute")), "_word"))
    return out.withColumn("key", F.coalesce(known, fallback_key(F.col("name")))).drop("_name", "_section", "_word", "_absolute")


def markers(tests: DataFrame, persons: DataFrame) -> DataFrame:
    """One marker for each person and key: the latest row with its range, status, severity and trend.

    tests: person_id, id, key, date (timestamp), name, value, qual, unit, ref_low, ref_high; persons:
    id, sex. A range without limits, or with one that is not believable, is replaced by the standard
    range for the person's sex. A qualitative result decides the status, else the value does.
    """
    spark = tests.sparkSession
    last = series.latest(tests, ["person_id", "key"], F.col("date"), F.col("id"))
    last = last.join(persons.select(F.col("id").alias("person_id"), F.nullif("sex", F.lit("")).alias("sex")), "person_id", "left")
    last = joins.by_precedence(last, rules.ranges(spark), "key", sex_rank(F.col("sex")))
    for dim in (rules.critical(spark), rules.plausible(spark), rules.units(spark)):
        last = last.join(F.broadcast(dim), "key", "left")
    believable = lambda c: F.coalesce(F.col(c).between(F.col("least"), F.col("most")), F.lit(True))
    own = (F.col("ref_low").isNotNull() | F.col("ref_high").isNotNull()) & believable("ref_low") & believable("ref_high")
    last = last.withColumn("low", F.when(own, F.col("ref_low")).otherwise(F.col("best.lo"))).withColumn("high", F.when(own, F.col("ref_high")).otherwise(F.col("best.hi")))
    v, low, high = F.col("value"), F.col("low"), F.col("high")
    qual, bounded = norm_qualifier(F.col("qual")), low.isNotNull() | high.isNotNull()
    by_value = F.when(v.isNull(), "no_realizado").when(bounded, clinical.numeric_status(v, low, high)).otherwise("normal")
    status = F.when(F.col("qual").isNotNull(), clinical.qualitative_status(qual)).otherwise(by_value)
    grade = F.when(F.col("qual").isNotNull(), clinical.qualitative_severity(qual, F.col("key"))).otherwise(clinical.severity(v, low, high, F.col("critical_high"), F.col("critical_low")))
    return last.select("person_id", "key", F.col("name").alias("label"), "value", F.coalesce(F.nullif(clean_unit(F.col("unit")), F.lit("")), "std_unit", F.lit("")).alias("unit"), "low", "high", status.alias("status"), grade.alias("severity"), "trend", "n", F.col("date").alias("last_date"), "sex")


def findings(marked: DataFrame, newest: DataFrame, aged_days: int = AGED_DAYS) -> DataFrame:
    """Markers that are not normal, with ``aged`` and a severity, and their rank among the person's.

    newest: person_id, newest (timestamp of the newest report). A marker over ``aged_days`` older than that is
    aged, and red becomes yellow; without a severity a finding is yellow. Red first, then by key.
    """
    out = marked.filter(~F.col("status").isin("normal", "no_realizado") & (F.col("key") != "psa_free")).join(newest, "person_id", "left")
    aged = F.coalesce(whole_days(F.col("newest"), F.col("last_date")) > aged_days, F.lit(False))
    grade = F.when(aged & (F.col("severity") == "red"), "yellow").otherwise(F.coalesce("severity", F.lit("yellow")))
    return out.withColumn("aged", aged).withColumn("severity", grade).drop("newest")


def explained(found: DataFrame) -> DataFrame:
    """Findings with the statistic that explains them and how their standard range reads, null where there is none."""
    spark = found.sparkSession
    return found.join(F.broadcast(rules.statistics(spark)), "key", "left").join(F.broadcast(rules.standard_range_texts(spark)), "key", "left")


def rank_findings(found: DataFrame) -> DataFrame:
    return series.top_per_group(found, ["person_id"], 2**31 - 1, clinical.severity_rank(F.col("severity")), F.col("key"))


def summary(found: DataFrame) -> DataFrame:
    """Numbers of red, yellow and aged findings of each person, and the tone of the whole."""
    red, yellow = F.count_if(F.col("severity") == "red"), F.count_if(F.col("severity") == "yellow")
    out = found.groupBy("person_id").agg(red.alias("n_red"), yellow.alias("n_yellow"), F.count_if("aged").alias("n_aged"))
    return out.withColumn("tone", F.when(F.col("n_red") > 0, "crítico").when(F.col("n_yellow") > 0, "precaución").otherwise("favorable"))


def roll_up(marked: DataFrame, dim: DataFrame, corrected: bool = False, parts: int = 3) -> DataFrame:
    """State of each body system of each person: its severity and the text of its first issues.

    dim: ord, system, key. An issue is a status other than normal. The severity shown is the mildest of
    the issues, none before yellow before red; ``corrected`` shows the gravest. A system without issues is
    normal; one without markers is not listed.
    """
    rows = marked.join(F.broadcast(dim), "key")
    issue = F.col("status") != "normal"
    text = F.concat(F.col("label"), F.lit(": "), F.coalesce(F.col("value").cast("string"), F.lit("None")), F.lit(" "), F.col("unit"), F.lit(" ("), F.col("status"), F.lit(")"))
    # every system has a handful of keys, so a list of a person's issues is short
    out = rows.groupBy("person_id", "system").agg(
        F.count_if(issue).alias("n_issues"),
        F.array_sort(F.collect_list(F.when(issue, F.struct("ord", text.alias("text"))))).alias("_texts"),
        (F.min if corrected else F.max)(F.when(issue, F.struct(clinical.severity_rank(F.col("severity")).alias("rank"), F.col("severity").alias("s")))).alias("_worst"),
    )
    shown = F.array_join(F.transform(F.slice("_texts", 1, parts), lambda x: x["text"]), "; ")
    return out.select("person_id", "system", F.when(F.col("n_issues") > 0, "alterado").otherwise("normal").alias("status"), F.col("_worst.s").alias("severity"), "n_issues", shown.alias("text"))


# Rules of recommendation: key (or * for others), severity, row, condition, title, urgency.
ADVICE = """
troponin | red | 1 | | TROPONINA ELEVADA | URGENTE
potassium | red | 1 | value > 5.5 | POTASIO CRÍTICO | URGENTE
platelets | red | 1 | value < 50000 | PLAQUETAS CRÍTICAMENTE BAJAS | URGENTE
glucose | yellow | 1 | value >= 100 and value < 126 | PREDIABETES | PRIORIDAD
glucose | yellow | 2 | value >= 100 and value < 126 | PERDER 5-7% DEL PESO | PRIORIDAD
glucose | yellow | 3 | | ESTADÍSTICA | INFORMATIVO
hba1c | yellow | 1 | value >= 5.7 and value < 6.5 | PREDIABETES | PRIORIDAD
hba1c | yellow | 2 | value >= 5.7 and value < 6.5 | PERDER 5-7% DEL PESO | PRIORIDAD
hba1c | yellow | 3 | | ESTADÍSTICA | INFORMATIVO
ldl | yellow | 1 | | LDL ELEVADO | PRIORIDAD
ldl | yellow | 2 | | ESTADÍSTICA | INFORMATIVO
trig | yellow | 1 | | TRIGLICÉRIDOS ELEVADOS | PRIORIDAD
trig | yellow | 2 | | ESTADÍSTICA | INFORMATIVO
hdl | yellow | 1 | | HDL BAJO | PRIORIDAD
hdl | yellow | 2 | | ESTADÍSTICA | INFORMATIVO
creatinine | yellow | 1 | | FUNCIÓN RENAL | SEGUIMIENTO
urea | yellow | 1 | | FUNCIÓN RENAL | SEGUIMIENTO
got | yellow | 1 | | FUNCIÓN HEPÁTICA | SEGUIMIENTO
gpt | yellow | 1 | | FUNCIÓN HEPÁTICA | SEGUIMIENTO
alp | yellow | 1 | | FUNCIÓN HEPÁTICA | SEGUIMIENTO
tsh | yellow | 1 | | TIROIDES | SEGUIMIENTO
t4_total | yellow | 1 | | TIROIDES | SEGUIMIENTO
t3_total | yellow | 1 | | TIROIDES | SEGUIMIENTO
uric_acid | yellow | 1 | | ÁCIDO ÚRICO | SEGUIMIENTO
crp | yellow | 1 | | INFLAMACIÓN | SEGUIMIENTO
psa_total | yellow | 1 | | PSA | SEGUIMIENTO
hemoglobin | yellow | 1 | | HEMOGLOBINA | SEGUIMIENTO
potassium | yellow | 1 | | POTASIO | SEGUIMIENTO
"""
# Advice for everyone, and for men.
ALWAYS = ("ACTIVIDAD FÍSICA", "ALIMENTACIÓN", "CONTROL ANUAL")
MEN = ("CONTROL DE PSA",)


def advice(spark: SparkSession, text: str = ADVICE) -> DataFrame:
    rows = [[x.strip() for x in line.split("|")] for line in text.strip().splitlines()]
    return spark.createDataFrame([(k, s, int(n), c or "true", t, u) for k, s, n, c, t, u in rows], "key string, severity string, seq int, condition string, title string, urgency string")


def recommendations(found: DataFrame, persons: DataFrame, text: str = ADVICE) -> DataFrame:
    """Rows of advice for each person: for red findings, then yellow ones, then for everybody.

    A finding gives the rows of the rules of its key and severity whose condition holds; a red one
    without such a rule one of high priority, a yellow one a general row, and an aged one only a
    reminder. Conditions are plain SQL over ``value``: the rule table is unfolded into one CASE.
    """
    spark = found.sparkSession
    parsed = [[x.strip() for x in line.split("|")] for line in text.strip().splitlines()]
    arrays = [F.when((F.col("key") == k) & (F.col("severity") == s) & F.coalesce(F.expr(c or "true"), F.lit(False)), F.struct(F.lit(int(n)).alias("seq"), F.lit(t).alias("title"), F.lit(u).alias("urgency"))) for k, s, n, c, t, u in parsed]
    ruled = F.filter(F.array(*arrays), lambda x: x.isNotNull())
    label = F.upper("label")
    one = lambda title, urgency: F.array(F.struct(F.lit(1).alias("seq"), title.alias("title"), F.lit(urgency).alias("urgency")))
    sugar = F.col("key").isin("glucose", "hba1c") & ~F.exists(ruled, lambda x: x["seq"] == 1)
    general = one(F.concat(label, F.lit(" "), F.upper("status")), "SEGUIMIENTO")
    rows = (
        F.when(F.col("aged"), one(F.concat(label, F.lit(" ALTERADO EN ANÁLISIS ANTERIOR")), "SEGUIMIENTO"))
        .when((F.col("severity") == "red") & (F.size(ruled) == 0), one(F.concat(label, F.lit(" ALTERADO — VALOR CRÍTICO")), "ALTA PRIORIDAD"))
        .when(F.col("severity") == "red", ruled)
        .when(sugar, F.concat(general, ruled))
        .when(F.size(ruled) == 0, general)
        .otherwise(ruled)
    )
    own = found.select("person_id", clinical.severity_rank(F.col("severity")).alias("group"), "key", F.col("severity").alias("level"), F.explode(rows).alias("r"))
    own = own.select("person_id", "group", "key", F.col("r.seq").alias("seq"), "level", F.col("r.title").alias("title"), F.col("r.urgency").alias("urgency"))
    everyone = spark.createDataFrame([(i, t, i >= len(ALWAYS)) for i, t in enumerate((*ALWAYS, *MEN))], "seq int, title string, men boolean")
    general_rows = persons.select(F.col("id").alias("person_id"), "sex").join(F.broadcast(everyone), ~F.col("men") | (F.col("sex") == "M"))
    green = general_rows.select("person_id", F.lit(2).alias("group"), F.lit("").alias("key"), "seq", F.lit("green").alias("level"), "title", F.lit("RECOMENDADO").alias("urgency"))
    return own.unionByName(green)


def resolved_medicines(meds: DataFrame, name: str = "name") -> DataFrame:
    """Medicines (person_id, pos, name) with ``drug`` and ``drug_name``, null where none is known.

    They are stored first: their names are looked up in several ways, and each would make the whole list anew.
    """
    spark = meds.sparkSession
    meds = stored(meds.withColumn("_norm", norm_text(F.col(name))), "medicines")
    known = joins.resolve_alias(meds, "_norm", rules.aliases(spark).withColumn("alias", norm_text(F.col("alias"))), "drug")
    return known.withColumnRenamed("match", "drug").join(F.broadcast(rules.drugs(spark)), "drug", "left").withColumnRenamed("_norm", "norm")


def lab_checks(resolved: DataFrame, marked: DataFrame, corrected: bool = False) -> DataFrame:
    """Effects of a person's medicines on their abnormal markers.

    A marker that is not high counts as low, unless ``corrected``, which asks for a low status.
    Interference always shows.
    """
    abnormal = marked.filter(F.col("status") != "normal").select("person_id", F.col("key").alias("test"), F.col("status").alias("marker_status"))
    effects = resolved.filter("drug is not null").join(F.broadcast(rules.lab_effects(resolved.sparkSession)), "drug")
    low = F.col("marker_status") == "bajo" if corrected else F.col("marker_status") != "alto"
    way = F.when(F.col("marker_status") == "alto", "up").when(low, "down")
    hit = effects.join(abnormal, ["person_id", "test"]).filter((F.col("direction") == "interferes") | (F.col("direction") == way))
    return hit.select("person_id", "drug", "drug_name", "test", "direction", "severity", "marker_status")


def drug_pairs(resolved: DataFrame) -> DataFrame:
    """Interactions between two medicines of a person, looked up from the earlier to the later, once a pair."""
    known = resolved.filter("drug is not null")
    listed = rules.interactions(resolved.sparkSession).select("drug", "ord", norm_text(F.col("other")).alias("other"), "severity")
    side = lambda s: ["person_id", *(F.col(c).alias(f"{c}_{s}") for c in ("pos", "drug_name", "norm"))]
    earlier = known.join(F.broadcast(listed), "drug").select(*side("a"), "ord", "other", "severity")
    later = known.select(*side("b"), F.explode(F.array_distinct(F.array(norm_text(F.col("drug_name")), "norm"))).alias("other"))
    hit = earlier.join(later, ["person_id", "other"]).filter("pos_a < pos_b")  # only pairs with an interaction are made
    key = F.array_sort(F.array("norm_a", "norm_b"))
    hit = hit.withColumn("pair", F.array_join(key, "|"))
    return series.first_wins(hit, ["person_id", "pair"], F.col("pos_a"), F.col("pos_b"), F.col("ord")).select("person_id", F.concat_ws(" + ", "drug_name_a", "drug_name_b").alias("drugs"), "severity")


def unknown_medicines(resolved: DataFrame) -> DataFrame:
    return resolved.filter("drug is null").select("person_id", "name")


def overall_severity(*checks: DataFrame) -> DataFrame:
    """The gravest severity of a person over several lists of checks."""
    rows = checks[0].select("person_id", "severity")
    for c in checks[1:]:
        rows = rows.unionByName(c.select("person_id", "severity"))
    return rows.groupBy("person_id").agg(F.min_by("severity", clinical.severity_rank(F.col("severity"))).alias("severity"))


def imaging_findings(analyses: DataFrame) -> DataFrame:
    """Findings of done analyses (document_id, created_at, findings_json) as rows, numeric ones numbered as markers.

    Text that is not a JSON array is skipped; a value counts as numeric unless it is true or false; the
    others are text findings with their first sentence.
    """
    kind = "array<struct<system:string,severity:string,text:string,value:string,unit:string>>"
    rows = analyses.select("document_id", "created_at", F.posexplode(F.from_json(F.regexp_extract("findings_json", r"(?s)(\[.*\])", 1), kind)).alias("pos", "f"))
    number = F.col("f.value").try_cast("double")
    system = F.coalesce(F.nullif(F.trim("f.system"), F.lit("")), F.lit("Estudio"))
    sentence = F.substring(F.split_part(F.trim(F.coalesce("f.text", F.lit(""))), F.lit("."), F.lit(1)), 1, 120)
    return rows.select("document_id", "created_at", "pos", system.alias("system"), F.coalesce("f.severity", F.lit("normal")).alias("severity"), F.coalesce(F.nullif(sentence, F.lit("")), system).alias("text"), number.alias("value"), F.coalesce(F.trim("f.unit"), F.lit("")).alias("unit"))


def fallback_report(found: DataFrame, most: int = 8) -> DataFrame:
    """A plain text of each person's first findings, for when no written report is stored."""
    line = F.concat(F.lit("- "), F.col("label"), F.lit(": "), F.coalesce(F.col("value").cast("string"), F.lit("")), F.lit(" "), F.col("unit"), F.lit(" ("), F.col("status"), F.lit(")"))
    top = rank_findings(found).filter(F.col("pos") <= most)
    return top.groupBy("person_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("t")))), lambda x: x["t"]), "\n").alias("report"))
