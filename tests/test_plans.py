"""Scenarios of the assessment, the catalogue and ingest."""

import datetime as dt
import re

from pyspark.sql import functions as F

from serieslab import rules
from serieslab.plans import assessment as a
from serieslab.plans import catalog, dispatch, ingest, layout

TESTS = "person_id long, id long, key string, name string, date timestamp_ntz, value double, qual string, unit string, ref_low double, ref_high double"
DAY = dt.datetime(2024, 6, 1, 8)


def rows_of(spark, rows):
    """rows: person, id, key, days before DAY (None: undated), value, qual, low, high."""
    data = [(p, i, k, k, None if d is None else DAY - dt.timedelta(days=d), v, q, "", lo, hi) for p, i, k, d, v, q, lo, hi in rows]
    return spark.createDataFrame(data, TESTS)


def persons(spark, *sexes):
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(sexes)], "id long, sex string")


def marked(spark, rows, *sexes):
    return {(r.person_id, r.key): r for r in a.markers(rows_of(spark, rows), persons(spark, *(sexes or ("M",)))).collect()}


def test_latest_and_trend(spark):
    m = marked(spark, [(1, 1, "glucose", 0, 90.0, None, None, None), (1, 2, "glucose", 0, 95.0, None, None, None), (1, 3, "ldl", 3, 80.0, None, None, None), (1, 4, "ldl", 2, None, None, None, None), (1, 5, "ldl", 1, 85.0, None, None, None), (1, 6, "hdl", None, 50.0, None, None, None), (1, 7, "hdl", 9, 60.0, None, None, None)])
    assert (m[1, "glucose"].value, m[1, "glucose"].trend, m[1, "glucose"].n) == (95.0, "subiendo", 2)  # of one date the larger id
    assert m[1, "ldl"].trend == ""  # the row before has no value and is not skipped
    assert m[1, "hdl"].value == 60.0  # undated rows come first


def test_ranges(spark):
    m = marked(spark, [(1, 1, "hemoglobin", 0, 13.0, None, None, None), (2, 2, "hemoglobin", 0, 13.0, None, None, None), (3, 3, "hemoglobin", 0, 13.0, None, None, None), (1, 4, "glucose", 0, 118.0, None, None, 5000.0), (1, 5, "trig", 0, 240.0, None, None, 150.0), (1, 6, "otro:x", 0, 5.0, None, None, None)], "M", "F", "")
    assert [m[i, "hemoglobin"].status for i in (1, 2, 3)] == ["bajo", "normal", "bajo"]
    assert (m[1, "glucose"].high, m[1, "glucose"].severity) == (100.0, "yellow")  # a limit of 5000 is not believed
    assert (m[1, "trig"].low, m[1, "trig"].severity) == (None, "red")
    assert (m[1, "otro:x"].status, m[1, "otro:x"].severity) == ("normal", None)


def test_qualitative(spark):
    rows = [(1, 1, "rh", 0, None, "Negativo", None, None), (1, 2, "influenza_a", 0, None, "POSITIVO", None, None), (1, 3, "blood_group", 0, None, "positivo", None, None), (1, 4, "rsv", 0, None, "Indeterminado", None, None), (1, 5, "uric", 0, None, "", None, None), (1, 6, "mpv", 0, None, None, None, None)]
    m = marked(spark, rows)
    assert [(m[1, k].status, m[1, k].severity) for k in ("rh", "influenza_a", "blood_group", "rsv", "uric")] == [("normal", None), ("positivo", "red"), ("positivo", "yellow"), ("no_realizado", None), ("no_realizado", None)]
    assert m[1, "mpv"].status == "no_realizado"


def found(spark, rows, *sexes):
    t = rows_of(spark, rows)
    newest = t.groupBy("person_id").agg(F.max("date").alias("newest"))
    return a.findings(a.markers(t, persons(spark, *(sexes or ("M",)))), newest)


def test_ageing(spark):
    f = {r.key: r for r in found(spark, [(1, 1, "glucose", 366, 260.0, None, None, None), (1, 2, "potassium", 365, 5.9, None, None, None), (1, 3, "psa_free", 0, 9.0, None, None, None)]).collect()}
    assert (f["glucose"].severity, f["glucose"].aged) == ("yellow", True)
    assert (f["potassium"].severity, f["potassium"].aged) == ("red", False)
    assert "psa_free" not in f


def test_systems(spark):
    rows = [(1, 1, "glucose", 0, 260.0, None, None, None), (1, 2, "hba1c", 0, None, "", None, None), (1, 3, "creatinine", 0, 1.0, None, None, None)]
    m = a.markers(rows_of(spark, rows), persons(spark, "M"))
    plain = {r.system: r for r in a.roll_up(m, rules.systems(spark)).collect()}
    fixed = {r.system: r for r in a.roll_up(m, rules.systems(spark), corrected=True).collect()}
    assert (plain["metabolic"].status, plain["metabolic"].severity, fixed["metabolic"].severity) == ("alterado", None, "red")
    assert plain["renal"].status == "normal" and plain["metabolic"].n_issues == 2


def advice(spark, rows, *sexes):
    f = found(spark, rows, *(sexes or ("M",)))
    out = a.recommendations(f, persons(spark, *(sexes or ("M",)))).orderBy("person_id", "group", "key", "seq").collect()
    return [(r.person_id, r.key, r.title) for r in out]


def test_recommendations(spark):
    got = advice(spark, [(1, 1, "glucose", 0, 118.0, None, None, None), (1, 2, "hba1c", 0, 6.0, None, None, None), (2, 3, "potassium", 0, 5.9, None, None, None), (2, 4, "ldl", 0, 190.0, None, None, None)], "M", "F")
    assert sum(k in ("glucose", "hba1c") for p, k, _ in got) == 6
    assert [t for p, k, t in got if p == 2 and k] == ["LDL ALTERADO — VALOR CRÍTICO", "POTASIO CRÍTICO"]
    assert (sum(p == 1 and not k for p, k, _ in got), sum(p == 2 and not k for p, k, _ in got)) == (4, 3)
    old = advice(spark, [(1, 1, "ldl", 500, 150.0, None, None, None), (1, 2, "hdl", 0, 50.0, None, None, None)])
    assert [t for _, k, t in old if k] == ["LDL ALTERADO EN ANÁLISIS ANTERIOR"]


def test_summary(spark):
    s = {r.person_id: r for r in a.summary(found(spark, [(1, 1, "glucose", 0, 260.0, None, None, None), (2, 2, "glucose", 0, 110.0, None, None, None)], "M", "F")).collect()}
    assert (s[1].n_red, s[1].tone, s[2].n_yellow, s[2].tone) == (1, "crítico", 1, "precaución")


def meds(spark, *names):
    return a.resolved_medicines(spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "person_id long, pos long, name string"))


def test_medicines(spark):
    assert [r.drug for r in meds(spark, "Metformin 850", "xyz").orderBy("pos").collect()] == ["metformina", None]
    assert [r.severity for r in a.drug_pairs(meds(spark, "Aspirina", "Warfarin")).collect()] == ["red"]
    assert a.drug_pairs(meds(spark, "Aspirina", "Warfarina")).count() == 0
    assert a.drug_pairs(meds(spark, "Enalapril", "Espironolactona")).count() == 0
    assert [r.name for r in a.unknown_medicines(meds(spark, "xyz", "Aspirina")).collect()] == ["xyz"]


def test_lab_checks(spark):
    m = a.markers(rows_of(spark, [(1, 1, "creatinine", 0, 2.0, None, None, None), (1, 2, "sodium", 0, 130.0, None, None, None), (1, 3, "tsh", 0, 0.1, None, None, None), (1, 4, "influenza_a", 0, None, "positivo", None, None)]), persons(spark, "M"))
    got = {(r.drug, r.test, r.severity) for r in a.lab_checks(meds(spark, "Ibuprofeno", "Biotina"), m).collect()}
    assert got == {("ibuprofeno", "creatinine", "yellow"), ("biotina", "tsh", "red")}
    assert [r.severity for r in a.overall_severity(a.lab_checks(meds(spark, "Ibuprofeno", "Biotina"), m)).collect()] == ["red"]


def test_canonical_keys(spark):
    rows = [("Glucosa en Ayunas", "mg/dL", ""), ("Hemoglobina Glicada (HbA1c)", "%", ""), ("Colesterol LDL calculado", "mg/dL", ""), ("Linfocitos", "10e3/µL", ""), ("Linfocitos", "%", "FORMULA LEUCOCITARIA"), ("Neutrófilos", "", "FORMULA ABSOLUTA"), ("Glucosa", "mg/dL", "ORINA SIMPLE"), ("Prolactina", "", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, unit string, section string")
    got = [r.key for r in a.canonical_keys(df, spark).orderBy("i").collect()]
    assert got == ["glucose", "hba1c", "ldl", "lymph_abs", "lymph_pct", "neut_abs", "otro:glucosa", "otro:prolactina"]


def test_range_texts(spark):
    t = {r.key: r.range_text for r in rules.standard_range_texts(spark).collect()}
    assert (t["crp"], t["tsh"], t["ck"]) == ("inferior a 6 mg/L", "entre 0,27 y 4,2 µUI/mL", "inferior a 170 U/L (hombre) · inferior a 145 U/L (mujer)")


def test_imaging_findings(spark):
    rows = [(1, "not json"), (2, '{"a": 1}'), (3, '[{"system": "Riñón", "text": "Quiste. Más", "value": true}, {"text": "x", "value": "7.5", "unit": " mm "}]')]
    got = a.imaging_findings(spark.createDataFrame(rows, "document_id long, findings_json string").withColumn("created_at", F.current_timestamp())).orderBy("pos").collect()
    assert [(r.document_id, r.system, r.text, r.value, r.unit) for r in got] == [(3, "Riñón", "Quiste", None, ""), (3, "Estudio", "x", 7.5, "mm")]


# catalogue

ENTRY = "key string, generic string, aliases array<string>, brands array<string>, strengths array<string>"


def test_search_tiers(spark):
    rows = [("e", "Losartan Y", [], [], []), ("d", "Colosar", [], [], ["1 mg"]), ("c", "Zed", [], ["Losarplus"], ["1 mg"]), ("b", "Yod", ["losar x"], [], ["1 mg"]), ("a2", "Losartan", [], [], ["1 mg"]), ("a1", "Losar", [], [], ["1 mg"])]
    df = spark.createDataFrame(rows, ENTRY)
    got = catalog.search(df, " Losar ").collect()
    assert [(r.key, r.tier) for r in got] == [("a1", 0), ("a2", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 1)]
    assert got[3].matched_brand == "Losarplus" and catalog.search(df, "l").count() == 0


def test_search_for_many_queries(spark):
    """The tiers, brands and order of the search for one query, for each of many."""
    rows = [("e", "Losartan Y", [], [], []), ("d", "Colosar", [], [], ["1 mg"]), ("c", "Zed", [], ["Aa losar", "Losarplus"], ["1 mg"]), ("b", "Yod", ["losar x"], [], ["1 mg"]), ("a2", "Losartan", [], [], ["1 mg"]), ("a1", "Losar", [], ["X", "Zlosar"], ["1 mg"]), ("f", "", [], [""], [])]
    df = spark.createDataFrame(rows, ENTRY).persist()
    asked = ["losar", " LOSAR ", "lo", "l", "", None, "zed", "a  l", "none", "osar", "yod", "ta"]
    frame = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "query_id int, query string")
    got = {}
    for r in catalog.search_many(df, frame, most=4).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.key, r.tier, r.matched_brand, r.undosed))
    for i, q in enumerate(asked):
        want = [(r.key, r.tier, r.matched_brand, r.undosed) for r in catalog.search(df, q or "", most=4).collect()]
        assert got.get(i, []) == want


def test_merge_and_match(spark):
    base = spark.createDataFrame([("losartan", "Losartan", ["losartan"], ["Cozaar"], ["50 mg"])], ENTRY)
    extra = spark.createDataFrame([("x", "Otro", ["losartan", "los"], ["B"], ["100 mg"]), ("nuevo", "Nuevo", ["n"], [], [])], ENTRY)
    got = {r.key: r for r in catalog.merge_overlay(base, extra).collect()}
    assert set(got) == {"losartan", "nuevo"} and got["losartan"].strengths == ["100 mg"] and set(got["losartan"].brands) == {"Cozaar", "B"}
    names = spark.createDataFrame([("Losartan potásico 50",), ("aspirina",)], "product string")
    assert {r.product: r.match for r in catalog.match_products(names, base).collect()} == {"Losartan potásico 50": "losartan", "aspirina": None}


def test_registry(spark, tmp_path):
    from serieslab.sources.registry import read_registry

    (tmp_path / "r.csv").write_text("NOME_PRODUTO;PRINCIPIO_ATIVO;TIPO_PRODUTO;SITUACAO_REGISTRO\nGlifage 500 mg;CLORIDRATO DE METFORMINA;MEDICAMENTO;Ativo\nMetform 850 mg;METFORMINA;Medicamento;ATIVO\nVelho;X;MEDICAMENTO;Caduco\nCreme;Ação;COSMETICO;Ativo\n", encoding="latin-1")
    got = catalog.group_products(read_registry(spark, str(tmp_path / "r.csv"))).collect()
    assert [(r.key, r.generic, r.brands, r.strengths) for r in got] == [("metformina", "METFORMINA", ["Glifage", "Metform"], ["500 mg", "850 mg"])]


# ingest


def test_persons(spark):
    known = spark.createDataFrame([(1, "ANA PEREZ GOMEZ", "123"), (2, "EVA PEREZ GOMEZ", "")], "id long, name string, doc string")
    new = spark.createDataFrame([(0, "Gomez Perez, Ana", ""), (1, "ANA PEREZ", ""), (2, "Someone Else", "123"), (3, "Nuevo Uno Dos", "9"), (4, "Nuevo Uno Dos", "9")], "i int, name string, doc string")
    got = {r.i: (r.person_id, r.created) for r in ingest.resolve_persons(new, known).collect()}
    assert got[0] == (1, False) and got[2] == (1, False) and got[1][1] and got[3] == got[4] and got[3][0] > 2


def test_new_reports(spark):
    schema = "seq int, key string, person_id long, date timestamp_ntz, lab string"
    from serieslab.operators.dedup import new_reports

    stored = spark.createDataFrame([(0, "k0", 1, DAY, "L"), (0, "k9", 1, None, "L")], schema)
    rows = [(1, "k0", 1, DAY, "L"), (2, "k1", 1, DAY, "L"), (3, "k2", 1, None, "L"), (4, "k3", 1, None, "L"), (5, "k4", 2, DAY, "L"), (6, "k5", 2, DAY, "L"), (7, "k5", 3, DAY, "L")]
    incoming = spark.createDataFrame(rows, schema)
    assert sorted(r.seq for r in new_reports(incoming, stored).collect()) == [3, 4, 5]
    assert sorted(r.seq for r in new_reports(incoming, stored, force=True).collect()) == [2, 3, 4, 5, 6]


def test_typed_rows(spark):
    raw = spark.createDataFrame([("Plaquetas", "250", "10e3/µL", "150 - 450"), ("Rh", "Positivo", "", ""), ("Nada", "", "", "")], "name string, result string, unit string, reference string")
    got = {r.name: r for r in ingest.typed_tests(raw).collect()}
    assert (got["Plaquetas"].value, got["Plaquetas"].ref_low, got["Plaquetas"].unit) == (250000.0, 150000.0, "/µL") and got["Rh"].qual == "Positivo" and "Nada" not in got


def test_layout(spark):
    page = [("HEMOGRAMA", 10, 0), ("Glucosa", 10, 10), ("en", 60, 10.8), ("95", 220, 10.2), ("mg/dL", 300, 10), ("70", 460, 10), ("-", 470, 10), ("100", 480, 10), ("enzimatico", 350, 20), ("Urea", 10, 30), ("31", 220, 30)]
    words = spark.createDataFrame([("d", 1, float(x), float(y), w) for w, x, y in page], "doc string, page int, x double, y double, word string")
    got = {r["name"]: r for r in layout.result_rows(words, "verdejo").collect()}
    assert got["Glucosa en"].result == "95" and got["Glucosa en"].reference == "70 - 100" and got["Glucosa en"].method == "enzimatico" and got["Urea"].section == "HEMOGRAMA"


def test_staging_and_entities(spark):
    sections = '[{"name": "S", "tests": [{"name": "a", "value": 1.5}, {"name": "b"}]}, {"name": "T", "tests": []}]'
    got = ingest.staged_tests(spark.createDataFrame([("k", sections)], "key string, sections_json string")).orderBy("pos").collect()
    assert [(r.section, r.name, r.value) for r in got] == [("S", "a", 1.5), ("S", "b", None)]
    t = spark.createDataFrame([(1, "doc 1234567 de ANA PEREZ y 1234567")], "i int, t string")
    assert [r.entity for r in ingest.text_entities(t, "i", "t").orderBy("pos").collect()] == ["1234567", "ANA PEREZ"]


def test_decisions(spark):
    pending = spark.createDataFrame([("k1", "Ana", ""), ("k2", "", ""), ("k3", "Eva", ""), ("k4", "Luz", "")], "key string, patient_name string, doc string")
    chosen = spark.createDataFrame([("k1", "approve", None, ""), ("k2", "rename", None, "Nuevo"), ("k3", "existing", 1, ""), ("k4", "cancel", None, ""), ("k9", "approve", None, "")], "key string, action string, target_id long, name string")
    got = {r.key: (r.outcome, r.person_id, r.person_name) for r in ingest.decide(pending, chosen, persons(spark, "M", "F")).collect()}
    assert got == {"k1": ("approve", 3, "Ana"), "k2": ("rename", 4, "Nuevo"), "k3": ("existing", 1, None), "k4": ("cancelled", None, None), "k9": ("not_found", None, None)}
    assert {r.outcome for r in ingest.decide(pending, spark.createDataFrame([("k3", "current", None, "")], chosen.schema), persons(spark, "M")).collect()} == {"error"}


def test_uploads(spark):
    results = spark.createDataFrame([(1, "new", 2), (1, "error", None), (1, "duplicate", 0), (1, "no_new", 0)], "person_id long, status string, new_reports int")
    assert [tuple(r) for r in ingest.upload_summary(results).collect()] == [(1, 3, 1, 2)]
    assert sorted(r.status for r in ingest.attachments(results).collect()) == ["error", "no_new"]
    documents = spark.createDataFrame([(1, 1, "pdf", "a"), (2, 1, "pdf", "b"), (3, 1, "image", "a"), (4, 1, "image", "c")], "id long, person_id long, kind string, stored_path string")
    analyses = spark.createDataFrame([(4, "done"), (3, "error")], "document_id long, status string")
    reports = spark.createDataFrame([(1, "a")], "person_id long, stored_path string")
    assert sorted(r.id for r in ingest.studies_to_analyse(documents, analyses, reports).collect()) == [2, 3]


def test_explained(spark):
    got = {r.key: (r.statistic, r.range_text) for r in a.explained(found(spark, [(1, 1, "glucose", 0, 118.0, None, None, None), (1, 2, "sodium", 0, 155.0, None, None, None)])).collect()}
    assert got["glucose"][0] == "diabetes_risk" and got["sodium"] == (None, "entre 135 y 145 mEq/L")


def placed(spark, found):
    """Words of lines of (x, text) cells."""
    rows = [("d", 1, x + i, 10.0 * y, w) for y, line in enumerate(found) for x, text in line for i, w in enumerate(text.split(" "))]
    return spark.createDataFrame(rows, "doc string, page int, x double, y double, word string")


def results(df):
    return [(r.section, r.name, r.value, r.unit, r.low, r.high, r.qual) for r in df.orderBy("place").collect()]


def test_two_column_layout(spark):
    from serieslab.plans import blocks

    page = [[(10.0, "SERIE ROJA")], [(10.0, "Hemoglobina 13,5"), (320.0, "12,0 - 16,0 g/dL")], [(10.0, "4.850.000")], [(10.0, "Eritrocitos"), (320.0, "4.500.000 - 5.100.000 /µL")], [(10.0, "ORINA")], [(10.0, "Glucosa Negativo")], [(10.0, "Nota sin nombre 7")]]
    got = results(blocks.curie_rows(placed(spark, page)))
    assert got[0] == ("SERIE ROJA", "Hemoglobina", 13.5, "g/dL", 12.0, 16.0, None)
    assert got[1][:2] == ("SERIE ROJA", "Eritrocitos") and got[1][2] is None  # dots are no thousands marks without a count's unit
    assert got[2] == ("ORINA", "Glucosa", None, "", None, None, "Negativo") or got[2][1:3] == ("Glucosa", None)


def test_block_layouts(spark):
    from serieslab.plans import blocks

    page = [[(10.0, "Glicemia 104"), (340.0, "Hasta 110 mg/dl")], [(10.0, "metodo enzimatico")], [(10.0, "Urea"), (340.0, "35")], [(340.0, "15 - 45 mg/dl")]]
    got = results(blocks.ypacarai_rows(placed(spark, page)))
    assert got == [("QUIMICA", "Glicemia", 104.0, "mg/dl", None, 110.0, None), ("QUIMICA", "Urea", 35.0, "mg/dl", 15.0, 45.0, None)]
    page = [[(10.0, "TSH")], [(10.0, "Material: suero")], [(10.0, "Resultado: 2,35")], [(10.0, "Adultos: 0,4 - 4,0")], [(10.0, "Hemoglobina glicada")], [(10.0, "4,9 %")], [(10.0, "Normal: inferior a S,7")]]
    got = results(blocks.sanacoop_rows(placed(spark, page)))
    assert got == [("PERFIL", "TSH", 2.35, "", 0.4, 4.0, None), ("PERFIL", "Hemoglobina glicada", 4.9, "", None, 5.7, None)]  # units are sought where the number was
    page = [[(10.0, "Laboratorio X")], [(10.0, "Anti HBs")], [(10.0, "Material: suero")], [(10.0, "Resultado: Negativo")], [(10.0, "1,4 U/mL ver nota")], [(10.0, "Positivo: superior a 10")], [(10.0, "Vitamina B12")], [(10.0, "Material: suero")], [(10.0, "Resultado: 350 pg/mL 200 a 900 pg/mL")]]
    got = results(blocks.neo_rows(placed(spark, page)))
    assert got == [("GENERAL", "Anti HBs", 1.4, "U/mL", None, None, "Negativo"), ("GENERAL", "Vitamina B12", 350.0, "pg/mL", 200.0, 900.0, None)]
    texts = spark.createDataFrame([("Paciente: PEREZ, ANA Sexo: F\nEdad: 41 años\nCI N°: 1234567\nFecha: 03-02-2024",)], "t string")
    r = blocks.header(texts, "t", "medvital").first()
    assert (r.patient, r.age, r.sex, r.document, str(r.date)[:10]) == ("ANA PEREZ", 41, "F", "1234567", "2024-02-03")
    junk = spark.createDataFrame([("Teléfono 021",), ("Glucosa",), (None,)], "n string").select(blocks.is_junk_row(F.col("n")).alias("j"))
    assert [r.j for r in junk.collect()] == [True, False, False]


def test_suggested_persons(spark):
    known = [(1, "Ana Peña Núñez", "1.234.567"), (2, "ROSA DIAZ LOPEZ", ""), (3, "Ana María Peña Núñez", ""), (4, "Luis Vera", "7654321"), (5, "Eva Ale Meza", ""), (6, "Eva Ale Meza", "999999"), (7, "Juan Cano Gill", "")]
    persons = spark.createDataFrame(known, "id long, name string, doc string")
    texts = [
        ("a", None, "paciente ANA PEÑA\nNÚÑEZ con CI 7654321 y 1234567"), ("b", 2, "ROSA DIAZ LOPEZ VERA y EVA MEZA ALE"), ("c", None, "ROSA LOPEZ y Ana Peña Núñez 12345 123456789"),
        ("d", None, ""), ("e", None, None), ("f", 4, "ROSA DIAZ LOPEZ EVA ALE MEZA"), ("g", None, "nada"),
    ]
    frame = spark.createDataFrame(texts, "key string, person_id long, text string")
    found = lambda df: sorted((r.key, r.place, r.person_id, r.match) for r in df.collect())
    want = [("a", 1, 4, "documento"), ("a", 2, 1, "nombre"), ("b", 1, 5, "nombre"), ("f", 1, 2, "nombre")]
    assert found(ingest.suggest_persons(frame, persons)) == want
    read = spark.createDataFrame([("g", "JUAN CANO GILL", ""), ("b", "JUAN CANO GILL", "999999"), ("f", "nadie", "1")], "key string, name string, doc string")
    assert found(ingest.suggest_persons(frame, persons, read)) == sorted([*want[:2], ("b", 1, 6, "documento"), ("b", 2, 5, "nombre"), want[3], ("g", 1, 7, "nombre")])
    header = spark.createDataFrame([("d", "JUAN CANO GILL", "1.23.4567")], read.schema)
    assert found(ingest.suggest_persons(frame, persons, header))[-3:] == [("b", 1, 5, "nombre"), ("d", 1, 1, "documento"), ("f", 1, 2, "nombre")]
    aliases = spark.createDataFrame([(7, "1234567")], "person_id long, doc string")
    assert found(ingest.suggest_persons(frame, persons, aliases=aliases))[:3] == [("a", 1, 4, "documento"), ("a", 2, 7, "documento"), ("a", 3, 1, "nombre")]
    assert found(ingest.suggest_persons(frame, persons, most=1)) == [w for w in want if w[1] == 1]


def test_lines_of_pages(spark):
    """Words join the last line within the tolerance, pages are apart, words without a height are lines of their own, and no word is shuffled once pages are made."""
    rows = [("d", 1, 5.0, 10.0, "b"), ("d", 1, 1.0, 10.9, "a"), ("d", 1, 1.0, 11.1, "c"), ("d", 1, 3.0, None, "z"), ("d", 1, 2.0, None, "y"), ("d", 2, 1.0, 11.0, "e"), ("e", 1, 1.0, 11.0, "f")]
    words = spark.createDataFrame(rows, "doc string, page int, x double, y double, word string")
    found = layout.gathered(layout.pages_of(words), 1.0)
    assert sorted((r.doc, r.page, r.line, r.y or 0, " ".join(v["word"] for v in r.w)) for r in found.collect()) == [("d", 1, 0, 10.0, "a b"), ("d", 1, 1, 11.1, "c"), ("d", 1, 2, 0, "y"), ("d", 1, 3, 0, "z"), ("d", 2, 0, 11.0, "e"), ("e", 1, 0, 11.0, "f")]
    assert sorted((r.doc, r.page, r.word, r.line) for r in layout.lines(words, 1.0).collect()) == [("d", 1, "a", 0), ("d", 1, "b", 0), ("d", 1, "c", 1), ("d", 1, "y", 2), ("d", 1, "z", 3), ("d", 2, "e", 0), ("e", 1, "f", 0)]
    again = layout.gathered(spark.createDataFrame(layout.pages_of(words).collect(), layout.pages_of(words).schema), 1.0)
    assert "Exchange" not in again._jdf.queryExecution().toString()
    assert layout.gathered(words.limit(0), 1.0).count() == 0


ODD_WORDS = "doc string, page int, x double, y double, word string"


def odd_words(spark):
    """Words of documents with later pages, a repeated document, missing keys, heights and words, and an empty word."""
    two = [("d8", 1, 10.0, 10.0, "Laboratorio"), ("d8", 1, 11.0, 10.0, "Ypacarai"), ("d8", 1, 10.0, 20.0, "Valores"), ("d8", 1, 11.0, 20.4, "obtenidos"), ("d8", 2, 10.0, 10.0, "Sanacoop"), ("d8", 3, 1.0, 5.0, "fin")]
    alone = [("d3", 2, 10.0, 10.0, "Ypacaraí"), ("d3", 2, 20.0, 10.0, "valores"), ("d3", 2, 30.0, 10.0, "obtenidos"), ("d3", 4, 10.0, 10.0, "Urea")]
    odd = [("d1", 1, 5.0, 10.0, "Brunelli"), ("d1", 1, 5.0, 10.0, "Brunelli"), ("d1", 1, 1.0, None, "perdido"), ("d1", 1, None, 30.0, "b"), ("d1", 1, 2.0, 30.0, None), ("d1", 1, 3.0, 30.0, ""), ("ORD5", 1, 1.0, 1.0, "x"), ("e", 1, 1.0, 1.0, None)]
    lost = [(None, 1, 1.0, 1.0, "Brunelli"), ("n", None, 1.0, 1.0, "Brunelli"), (None, None, 1.0, 1.0, "z")]
    return spark.createDataFrame([*two, *alone, *odd, *lost], ODD_WORDS)


def test_routed_odd_words(spark):
    """Pages without a document or number are left out, a second report needs its laboratory on a later page, and words without heights come first in a text and last on a page."""
    found = dispatch.routed(odd_words(spark))
    assert dict(found.dtypes) == {"doc": "string", "page": "int", "text": "string", "words": "array<struct<x:double,word:string,y:double>>", "part": "int", "layout": "string"}
    got = sorted((r.doc, r.page, r.layout, r.part, r.text, [(v.x, v.word, v.y) for v in r.words]) for r in found.collect())
    assert [g[:5] for g in got] == [("ORD5", 1, "curie", 0, "x"), ("d1", 1, "brunelli", 0, "perdido\nBrunelli Brunelli\nb "), ("d3", 2, "ypacarai", 0, "Ypacaraí valores obtenidos"), ("d8", 1, "ypacarai", 0, "Laboratorio Ypacarai\nValores obtenidos"), ("d8", 2, "sanacoop", 1, "Sanacoop"), ("d8", 3, "sanacoop", 1, "fin"), ("e", 1, "verdejo", 0, "")]
    assert got[1][5] == [(5.0, "Brunelli", 10.0), (5.0, "Brunelli", 10.0), (None, "b", 30.0), (2.0, None, 30.0), (3.0, "", 30.0), (1.0, "perdido", None)]
    assert dispatch.routed(odd_words(spark).limit(0)).count() == 0


def plans_of_routed(spark, monkeypatch, **fixed):
    """What ``routed`` stores, by name, as it is planned."""
    kept, store = {}, dispatch.stored
    monkeypatch.setattr(dispatch, "stored", lambda df, name: store(kept.setdefault(name, df), name))
    for name, value in fixed.items():
        monkeypatch.setattr(dispatch, name, value)
    return kept, dispatch.routed(odd_words(spark))


def test_words_are_dealt_before_they_are_gathered(spark, monkeypatch):
    """No task gathers the words that it reads: they go by page to as many tasks as there are words for, and are gathered there."""
    kept, _ = plans_of_routed(spark, monkeypatch, WORDS_A_TASK=4)
    plan = next(df for name, df in kept.items() if "page" in name)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ObjectHashAggregate") < plan.rindex("ObjectHashAggregate") < plan.index("Exchange hashpartitioning(doc") and plan.count("Exchange") == 1
    assert "REPARTITION_BY_NUM" in plan and ", 6), REPARTITION" in plan  # 21 words


def test_pages_stay_rows_when_they_are_routed(spark, monkeypatch):
    """Texts and words of a page are found together, and routes are hashed for pages that no join sorts, by page and not by document."""
    kept, found = plans_of_routed(spark, monkeypatch, WORDS_ROUTED_A_TASK=4)
    made, joined = (df._jdf.queryExecution().executedPlan().toString() for df in (kept["pages"], found))
    assert "Join" not in made and made.count("Exchange") == 1
    assert joined.count("Join") == 1 and "ShuffledHashJoin [doc" in joined and "Sort [" not in joined
    assert joined.count("Exchange") == 3 and len(re.findall(r"Exchange hashpartitioning\(doc#\d+, page#\d+, 6\)", joined)) == 2  # 21 words
