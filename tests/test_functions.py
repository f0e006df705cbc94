"""Golden pairs of the scalar functions."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from serieslab.functions import clinical, dates, numbers, text
from serieslab.plans.catalog import base_principle, brand_name


def column(spark, rows, schema, make):
    """Values of ``make`` over rows, in order."""
    data = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    names = [f"c{i}" for i in range(len(data[0]) - 1)]
    df = spark.createDataFrame(data, "i int, " + ", ".join(f"{n} {t}" for n, t in zip(names, schema.split(), strict=True)))
    return [r.out for r in df.select("i", make(*map(F.col, names)).alias("out")).orderBy("i").collect()]


def test_parse_number(spark):
    pairs = [("1.234,56", "", 1234.56), ("1,234.56", "", 1234.56), ("5,7", "%", 5.7), ("4.500", "/µL", 4500), ("3.135", "10e3/µL", 3.135), ("37.5", "U/L", 375), ("-Z0-110.", "", 110), ("10e3/µL 0.000", "", 0), ("1.2.3", "", None), ("abc", "", None), ("1 234", "", 1234), ("1\u00a0234,5", "", 1234.5), ("4.5", "x10/µL", 45), ("110.", "", 110)]
    assert column(spark, [p[:2] for p in pairs], "string string", numbers.parse_number) == [p[2] for p in pairs]
    assert column(spark, [("37.5", "U/L")], "string string", lambda s, u: numbers.parse_number(s, u, corrected=True)) == [37.5]


def test_parse_range(spark):
    pairs = [("70 - 100 mg/dL", "", 70, 100), ("13,5 a 17,5", "", 13.5, 17.5), ("Hasta 150", "", None, 150), ("< 5,7", "", None, 5.7), ("> 40", "", 40, None), ("Niños hasta 15 años: hasta 400", "", None, 400), ("4.500.000 - 5.850.000", "/µL", 4500000, 5850000), ("4.500.000 - 5.850.000", "", None, None), ("sin datos", "", None, None)]
    got = column(spark, [p[:2] for p in pairs], "string string", numbers.parse_range)
    assert [(g.low, g.high) for g in got] == [p[2:] for p in pairs]


def test_parse_range_odd_texts(spark):
    """Other dashes, blanks of any kind, numbers that are none, missing texts and units, limits named more than once."""
    pairs = [
        (None, "", None, None), ("", None, None, None), ("70—110", None, 70, 110), ("70 − 1,5", "", 70, 1.5), ("1,  5 – 2,\t75", "", 1.5, 2.75), ("7\n-\t8", "", 7, 8), (". - .", "", None, None), ("..,5 - 9.", "", 5, 9), ("hasta\t 5 menor\na 7", "", None, 7), ("Mayor a 3 hasta 9", "", None, 9), ("SUPERIOR  A\n4 > 6,0", "", 6, None),
        ("hasta .", "", None, None), ("> ,", "", None, None), ("mayor a 1.500", "/µL", 1500, None), ("1.500 a 2,5", "10e3/µL", 1.5, 2.5), ("1\u00a0- 2", "", None, None), ("5 -", "", None, None), ("1 - 2 - 3", "", 1, 2), ("1.2.3 - 4 hasta 5", "", None, 4), ("37.5 - 40.5", "U/L", 375, 405),
    ]
    got = column(spark, [p[:2] for p in pairs], "string string", numbers.parse_range)
    assert [(g.low, g.high) for g in got] == [p[2:] for p in pairs]
    assert column(spark, [("37.5 - 40.5", "U/L")], "string string", lambda t, u: numbers.parse_range(t, u, corrected=True)) == [(37.5, 40.5)]


def test_parse_range_parses_two_numbers(spark):
    """Limits are chosen as texts, so a number is parsed for each of both, not for each way to write them."""
    text = spark.createDataFrame([("1 - 2",)], "t string")
    number, limits = (text.select(f(F.col("t"), F.lit("")).alias("r"))._jdf.queryExecution().optimizedPlan().toString().count(r"(\d[\d.,]*)") for f in (numbers.parse_number, numbers.parse_range))
    assert number > 0 and limits <= 2 * number


def test_dates(spark):
    shown = column(spark, ["31/07/2026 07:13", "5/3/24", "31/02/2024", "12/31/2024", "2024-01-05"], "string", lambda c: dates.iso(dates.parse_date(c)))
    assert shown == ["2026-07-31T07:13:00", "2024-03-05T00:00:00", None, None, None]
    births = column(spark, ["5-3-1980", "05/03/1980", "1980-3-5", "abc"], "string", dates.normal_birth)
    assert births == ["1980-03-05", "1980-03-05", "1980-03-05", "abc"]
    assert str(column(spark, ["am 05/06/2021 und 1/2/2020, 40/1/2000"], "string", dates.earliest_date)[0]) == "2020-02-01"
    assert column(spark, ["hombre de 47 años", "x"], "string", dates.parse_age) == [47, None]
    assert column(spark, ["2024-05-06T07:08:09.123"], "string", dates.plain_timestamp) == ["2024-05-06 07:08:09"]


def test_units(spark):
    pairs = [(4.5, "10e3/µL", 4500, "/µL"), (4.5, "10e6/µL", 4500000, "/µL"), (90.0, "mg/dL", 90, "mg/dL"), (7000.0, "/uL", 7000, "/µL")]
    rows = [p[:2] for p in pairs]
    assert column(spark, rows, "double string", numbers.to_common) == [p[2] for p in pairs]
    assert column(spark, rows, "double string", lambda v, u: numbers.common_unit(u)) == [p[3] for p in pairs]
    assert column(spark, ["Deseable: Inferior a 150 mg/dL", "md/dL", "mg/dL", None], "string", numbers.clean_unit) == ["mg/dL", "mg/dL", "mg/dL", ""]


def test_flag(spark):
    assert column(spark, [(5.0, 6.0, 9.0), (10.0, 6.0, 9.0), (7.0, 6.0, 9.0), (7.0, None, None), (10.0, None, 9.0)], "double double double", clinical.flag) == ["L", "H", "N", "", "H"]


def test_severity(spark):
    critical = {"glucose": (250.0, 45.0), "potassium": (5.5, 3.0)}
    cases = [(110, 70, 100, "glucose", "yellow"), (118, 70, 100, "glucose", "yellow"), (119, 70, 100, "glucose", "red"), (260, 70, 100, "glucose", "red"), (90, 70, 100, "glucose", "yellow"), (11.5, 12, 16, "hemoglobin", "yellow"), (35, 40, 100, "hdl", "yellow"), (150, 0, 100, "ldl", "yellow"), (190, 0, 100, "ldl", "red"), (5.3, 3.5, 5.1, "potassium", "yellow"), (5.6, 3.5, 5.1, "potassium", "red"), (240, None, 150, "trig", "red"), (200, None, 150, "trig", "yellow"), (15, 40, None, "hdl", "red"), (None, 70, 100, "glucose", None), (90, None, None, "glucose", None)]
    number = lambda x: None if x is None else float(x)
    rows = [(*map(number, c[:3]), *critical.get(c[3], (None, None))) for c in cases]
    assert column(spark, rows, "double double double double double", clinical.severity) == [c[4] for c in cases]


def test_names(spark):
    assert column(spark, ["PEREZ GOMEZ, ANA", "Maria de la Cruz", "LABORATORIO X S.R.L", "CURIE", None], "string", text.person_name) == ["ANA PEREZ GOMEZ", "MARIA CRUZ", "", "", None]
    assert column(spark, ["María de la Ñuñez x"], "string", text.name_tokens) == [["maria", "nunez"]]
    assert column(spark, ["JOSÉ Luis"], "string", text.given_name) == ["jos"]


def plain_norm(s):
    s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()
    return " ".join("".join(c if c.isalnum() else " " for c in s).split())


def test_norm_text(spark):
    letters = "".join(chr(c) for c in range(0x20, 0x250) if chr(c).isalnum() and len(unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore")) <= 1)
    cases = ["Glucosa en Ayunas!", "Colesterol (LDL)  calculado", "10³/µL ªº", letters, "ÀÉ-îõü/Ñ", "日本 abc"]
    assert column(spark, cases, "string", text.norm_text) == [plain_norm(c) for c in cases]
    assert column(spark, ["Prolactina"], "string", text.fallback_key) == ["otro:prolactina"]


@pytest.mark.parametrize(("shown", "home", "abroad"), [("LOSARTAN 50 MG COMPRIMIDO", ["50 mg"], ["50 mg"]), ("AMOXICILINA 500MG/5ML", ["500 mg"], ["500 mg", "5 ml"]), ("X 0.5 mg", ["0,5 mg"], ["0,5 mg"]), ("X 850 microgramos", ["850 mcg"], ["850 mcg"]), ("X 1.000 UI", ["1000 UI"], ["1 UI"]), ("X 80/12,5 mg", ["80/12,5 mg"], ["80/12,5 mg"]), ("X 100 mg/ml", ["100 mg/ml"], ["100 mg/ml"])])
def test_strengths(spark, shown, home, abroad):
    assert column(spark, [shown], "string", numbers.strength_labels) == [home]
    assert column(spark, [shown], "string", lambda c: numbers.strength_labels(c, abroad=True)) == [abroad]


def test_principles_and_brands(spark):
    assert column(spark, ["CLORIDRATO DE METFORMINA", "LEVOTIROXINA SODICA", "PARACETAMOL, CAFEINA", "A + B"], "string", base_principle) == ["METFORMINA", "LEVOTIROXINA", "", ""]
    assert column(spark, ["Glifage XR 500 mg comprimidos", "Cápsulas Ñandú® 20"], "string", brand_name) == ["Glifage", "Ñandú"]


def test_meter_and_tooltip(spark):
    assert column(spark, [(85.0,), (200.0,), (0.0,)], "double", lambda v: numbers.range_meter(v, F.lit(70.0), F.lit(100.0))) == [50.0, 98.0, 2.0]
    assert column(spark, [(None, 1.5, 1200.0), ("-", None, 5.0), ("propio", 1.0, 2.0), (None, None, None)], "string double double", lambda t, a, b: numbers.range_tooltip(t, a, b, F.lit("mg"))) == ["Rango deseado: 1,5 – 1.200 mg", "Rango deseado: inferior a 5 mg", "propio", ""]
    assert column(spark, [(80.0, 180.0)], "double double", numbers.bmi) == [24.7]


def test_identifiers(spark):
    assert column(spark, ["http://x/?study=1.2.3&y", "http://x/?manage=ab1", "http://x/study/9.8/", "http://x/"], "string", text.study_uid) == ["1.2.3", "ab1", "9.8", None]
    assert column(spark, [("s", "L", None)], "string string string", text.report_key) == ["s|L|None"]
    assert column(spark, ["a.PDF", "b.dcm", "c.tar.jpg", "noext"], "string", text.file_kind) == ["pdf", "dicom", "image", "other"]
    assert column(spark, ["/srv/data/uploads/x.pdf", "rel/x.pdf"], "string", text.relative_path) == ["uploads/x.pdf", "rel/x.pdf"]
    assert column(spark, ["x brunelli y", "ypacarai valores obtenidos", "angiotac medicina", "nada"], "string", text.detect_layout) == ["brunelli", "ypacarai", "medvital", "verdejo"]
