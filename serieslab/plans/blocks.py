"""Laboratory pages that are no tables: names of tests with the lines after them, and headers of patients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieslab.functions.dates import parse_date
from serieslab.functions.numbers import parse_number, parse_range
from serieslab.functions.text import clean_text, norm_text, person_name
from serieslab.operators import series
from serieslab.plans.layout import gathered

# Line tolerance of a layout and where its right column begins.
PLACES = {"curie": (1.0, 300.0), "ypacarai": (2.5, 330.0), "sanacoop": (1.0, None), "neo": (1.0, None), "medvital": (1.0, None)}
# Names of tests that begin a row or block.
CURIE_TEST = r"(?i)^(leucocitos|eritrocitos|hemoglobina|hematocrito|v\.c\.m\.|h\.c\.m\.|c\.h\.c\.m\.|ade|plaquetas|neutr[óo]filos segmentados|linfocitos|monocitos|eosin[óo]filos|bas[óo]filos|creatinina|urea|acido urico|colesterol total|colesterol ldl|colesterol hdl|colesterol vldl|trigliceridos|lipidos totales|fosfolipidos|asat \(got\)|alat \(gpt\)|bilirrubina total|fosfatasa alcalina|glicemia|calcio total|fosforo|magnesio|ck total|ck mb|ldh|pas total|tsh|t4 libre|t4 total|t3 libre|t3 total|vitamina d|ferritina|glucosa|hba1c|hemoglobina glicada|acido urico sangre|glucosa en sangre)\b"
YPACARAI_TEST = r"(?i)^(glicemia|glucosa|urea|creatinina|acido urico|colesterol total|hdl|ldl|vldl|triglic[ée]ridos|l[íi]pidos totales|got|gpt|bilirrubina\s*t|bilirrubina\s*d|bilirrubina\s*i|fosfatasa alcalina|calcio|proteinas totales|albumina|amilasa|f[óo]sforo|magnesio|colesterol)\b"
SANACOOP_TEST = r"(?i)^(hemoglobina glicada\s*\w*|tsh\s*\w*|t4\s*(?:libre|total)?|t3\s*(?:libre|total)?|pas\s*(?:total|libre)?|vitamina d|ferritina|prolactina|cortisol|glucosa|creatinina|urea|colesterol|trigliceridos|hba1c|glicemia)\b"
# Sections of the layout with two columns, results in words, labels of lines, and units.
CURIE_SECTIONS = ("serie blanca", "serie roja", "plaquetas", "formula leucocitaria", "formula absoluta", "perfil lipidico sangre", "perfil hepatico sangre", "orina simple chorro medio", "examen fisico", "examen quimico", "examen del sedimento", "sedimento urinario", "glucemia", "glucemia sangre", "creatinina sangre", "urea sangre", "glicemia sangre")
QUALITIES = ("negativo", "positivo", "no detectable", "neg", "pos")
NEO_LABEL = r"(?i)^(material|m[ée]todo|resultado|intervalo|indeterminado|negativo|positivo|ant[ií]geno|este ensayo|observa|fecha y hora|paciente|c[oó]digo|laboratorio|p[aá]gina|firma digital)"
UNIT = r"((?:10[eE]?3/|10[eE]?6/|x10[36]/|10³/|10⁶/)?\s*(?:mg/dL|g/dL|mg/dl|g/dl|mg%|mg|mmol/mol|mmol/L|mEq/L|mEq/l|uL|µL|μL|ng/mL|ng/ml|pg/dL|pg/ml|µg/dL|μg/dL|µIU/mL|μIU/mL|mU/L|U/L|U/I|uI/mL|IU/mL|fL|pg|%|mm/h|mg/d?|dl|g|ml|l|dL|gldl|gdl|md/dl))"
JUNK_ROW = r"(?i)^(tel[eé]fono|tel\.|direcci[oó]n|cel\.?|celular|correo|e-?mail|fax|whatsapp|ruc|reg\.?\s*prof|registro\s+profesional|p[aá]gina|impreso(\s+por)?|avda\.?|avenida|calle|firma\b)"
# Where each layout has the patient, age, sex, document and date.
HEADERS = {
    "curie": (r"(?i)paciente\s*:?\s*([^\n]+?)(?:Edad:|\n|$)", r"(?i)edad\s*:?\s*(\d{1,3})\s*a", r"(?i)sexo\s*:?\s*([MF])", r"(?is):\s*(\d{6,})\s*\n.*?CI\s*N\s*[°ºÂ]", r"(?i)fecha\s+de\s+ingreso\s*:?\s*([\d/]+\s+[\d:]+)"),
    "ypacarai": (r"(?i)nombre\s+usuario\s*:?\s*([^\n]+)", r"(?i)edad\s*:?\s*(\d{1,3})\s*a", None, None, r"(?i)fecha\s*:?\s*([\d/]+)"),
    "sanacoop": (r"(?i)paciente\s*:?\s*([^\n]+)", r"(?i)edad\s*:?\s*(\d{1,3})\s*a", r"(?i)sexo\s*:?\s*([MF])", r"(?i)doc\.?\s*n[°º]?\s*:?\s*([\d-]+)", r"(?i)fecha\s+de\s+(?:toma\s+de\s+)?muestra\s*:?\s*([\d/]+)"),
    "medvital": (r"(?i)paciente\s*:?\s*([^\n]+?)(?:Sexo|\n|$)", r"(?i)edad\s*:?\s*(\d{1,3})", r"(?i)sexo\s*:?\s*([MF])", r"(?i)c\.?i\.?\s*n[°º]?\s*:?\s*([\d]+)", r"(?i)fecha\s*:?\s*([\d-]+)"),
    "neo": (r"(?i)paciente\s*:?\s*([^\n]+?)\s+doc\.?\s*n", r"(?i)edad\s*:?\s*(\d{1,3})\s*a", r"(?i)sexo\s*:?\s*([MF])", r"(?i)doc\.?\s*n[°º]?\s*:?\s*([\d-]+)", r"(?i)impreso\s*:?\s*([\d/]+\s*-?\s*[\d:]*)"),
}
# How a number and a range are written.
NUMBER, RANGE = r"(-?\d[\d.,]+)", r"\b\d[\d.,]*\s*[-–—]\s*\d[\d.,]*\b"


def is_junk_row(name: Column) -> Column:
    """Whether what stands where a test's name would is an address, a telephone or a footer."""
    return F.trim(F.coalesce(name, F.lit(""))).rlike(JUNK_ROW)


def header(texts: DataFrame, text: str, layout: str) -> DataFrame:
    """Texts of reports with ``patient``, ``age``, ``sex``, ``document`` and ``date`` as the layout writes them; null where absent."""
    t = clean_text(F.col(text))
    found = lambda p: F.nullif(F.trim(F.regexp_extract(t, p, 1)), F.lit("")) if p else F.lit(None).cast("string")
    patient, age, sex, document, date = (found(p) for p in HEADERS[layout])
    date = parse_date(F.translate(date, "-", "/" if layout == "medvital" else " "))
    return texts.select("*", person_name(patient).alias("patient"), age.cast("int").alias("age"), F.upper(sex).alias("sex"), F.btrim(document, F.lit("- ")).alias("document"), date.alias("date"))


def text_lines(words: DataFrame, layout: str) -> DataFrame:
    """One row for each line of a page: place, text, and the texts of its left and right column."""
    tolerance, split = PLACES[layout]
    rows = gathered(words, tolerance)
    said = lambda w: clean_text(F.array_join(F.transform(w, lambda x: x["word"]), " "))
    left = F.filter("w", lambda x: x["x"] < split) if split else F.col("w")
    right = F.filter("w", lambda x: x["x"] >= split) if split else F.slice("w", 1, 0)
    return rows.select("doc", (F.col("page") * 100000 + F.col("line")).alias("place"), said(F.col("w")).alias("text"), said(left).alias("left"), said(right).alias("right"))


def unit_in(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, UNIT, 1)), F.lit(""))


def _last_number(c: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(1)), F.lit(-1))


def _sound(c: Column) -> Column:
    """A range with a limit, whose limits are in order."""
    r = parse_range(c, F.lit(""))
    return F.when((r["low"].isNotNull() | r["high"].isNotNull()) & ~F.coalesce(r["low"] > r["high"], F.lit(False)), r)


def curie_rows(words: DataFrame) -> DataFrame:
    """Two columns: a name with its result on the left, or with the result on the line above; range and unit on the right."""
    rows, key = text_lines(words, "curie"), norm_text(F.col("left"))
    capitals = (F.col("left") != "") & ~F.col("left").rlike(r"\d") & (F.length("left") < 30) & (F.upper("left") == F.col("left")) & (F.lower("left") != F.col("left"))
    rows = rows.withColumn("heading", key.isin(*CURIE_SECTIONS) | (capitals & ~key.isin("resultados", "intervalo")))
    rows = rows.withColumn("above", series.previous_line("doc", ["place"], F.when(F.col("heading"), F.lit("")).otherwise(F.col("left"))))
    rows = series.carry_forward(rows, "doc", ["place"], F.when(F.col("heading"), F.trim("left")), "section")
    rows = rows.withColumn("name", F.regexp_extract("left", CURIE_TEST, 1)).filter(~F.col("heading") & (F.col("name") != ""))
    rows = rows.withColumn("rest", F.trim(F.substr("left", F.length("name") + 1)))
    own, above = parse_number(F.col("rest"), F.lit("")), parse_number(F.col("above"), F.lit(""))
    raw = F.nullif(F.regexp_extract(F.when(own.isNull(), F.col("above")).otherwise(F.col("rest")), NUMBER, 1), F.lit(""))
    unit, r = F.coalesce(unit_in(F.col("right")), unit_in(F.col("rest")), F.lit("")), parse_range(F.col("right"), F.lit(""))
    whole = unit_in(F.regexp_replace("right", r"\s*/\s*", "/"))  # a unit may stand in two pieces
    unit = F.when(F.lower(unit).isin("mg", "dl", "g", "ml", "l"), F.coalesce(whole, unit)).otherwise(unit)
    value = F.coalesce(own, above)
    qual = F.when(value.isNull() & norm_text(F.col("rest")).isin(*QUALITIES), F.col("rest"))
    return rows.select("doc", "place", F.coalesce("section", F.lit("GENERAL")).alias("section"), "name", value.alias("value"), F.coalesce(raw, "rest").alias("raw"), unit.alias("unit"), r["low"].alias("low"), r["high"].alias("high"), F.col("right").alias("reference"), qual.alias("qual"))


def _first(value: str) -> Column:
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col("place")))


def ypacarai_rows(words: DataFrame) -> DataFrame:
    """Blocks of a name and the lines after it: the first number on the left is the value, the first sound range the reference.

    Where the left column has no number, one on the right counts, unless its line gave the reference.
    """
    rows = text_lines(words, "ypacarai")
    rows = series.blocks(rows, "doc", ["place"], F.trim("text").rlike(YPACARAI_TEST)).filter("block > 0")
    begin = F.when(F.trim("text").rlike(YPACARAI_TEST), F.regexp_extract(F.trim("text"), YPACARAI_TEST, 1))
    rows = series.carry_forward(rows, "doc", ["place"], begin, "name")
    rows = series.carry_forward(rows, "doc", ["place"], F.when(begin.isNotNull(), F.col("place")), "top")
    rows = rows.filter(F.col("place") - F.col("top") < 8).withColumn("tokens", F.split(norm_text(F.col("name")), " "))
    rows = rows.withColumn("left", F.array_join(F.filter(F.split("left", " "), lambda w: ~F.array_contains("tokens", norm_text(w))), " "))
    whole = F.concat_ws(" ", "left", "right")
    like = (whole.rlike("(?i)hasta|menor|mayor|inferior|superior|hombres|mujeres|normal") & whole.rlike(r"\d")) | whole.rlike(RANGE)
    rows = rows.withColumn("whole", whole).withColumn("like", like).withColumn("range", F.when(like, _sound(whole)))
    rows = rows.withColumn("given", F.min(F.when(F.col("range").isNotNull(), F.col("place"))).over(Window.partitionBy("doc", "block")))
    spent = F.col("like") & (F.col("given").isNull() | (F.col("place") <= F.col("given")))
    rows = rows.withColumn("raw", F.coalesce(_last_number(F.col("left")), F.when(~spent, _last_number(F.col("right"))))).withColumn("value", parse_number(F.col("raw"), F.lit("")))
    rows = rows.withColumn("raw", F.when(F.col("value").isNotNull(), F.col("raw"))).withColumn("reference", F.when(F.col("range").isNotNull(), F.trim("whole")))
    out = rows.groupBy("doc", "block", "name").agg(F.min("place").alias("place"), *(_first(c).alias(c) for c in ("value", "raw", "range", "reference")))
    return _finished(out, "QUIMICA", ("reference", "raw"))


def _finished(out: DataFrame, section: str, unit_from: tuple[str, str]) -> DataFrame:
    unit = F.coalesce(unit_in(F.coalesce(*unit_from)), F.lit(""))
    return out.select("doc", "place", F.lit(section).alias("section"), "name", "value", F.coalesce("raw", F.lit("")).alias("raw"), unit.alias("unit"), F.col("range.low").alias("low"), F.col("range.high").alias("high"), F.coalesce("reference", F.lit("")).alias("reference"), F.lit(None).cast("string").alias("qual"))


def sanacoop_rows(words: DataFrame) -> DataFrame:
    """Blocks of a name and labelled lines: the last result counts, else a short line with a number and unit; the last sound range."""
    rows = text_lines(words, "sanacoop")
    begins = F.trim("text").rlike(SANACOOP_TEST)
    rows = series.carry_forward(rows, "doc", ["place"], F.when(begins, F.trim(F.regexp_extract(F.trim("text"), SANACOOP_TEST, 1))), "name")
    rows = series.blocks(rows, "doc", ["place"], begins).filter("block > 0")
    rows = rows.withColumn("above", series.previous_line("doc", ["place"], F.when(begins, F.lit("")).otherwise(F.col("text")))).filter(~begins)
    key = norm_text(F.col("text"))
    label = key.rlike("material|metodo|observa|firma|muestra|impreso|pagina|estandar|prog|hora de")
    result = ~label & key.contains("resultado")
    limits = ~label & ~result & key.rlike("nivel|adultos|hombres|mujeres|intervalo|normal|pre|diabetes|referencia|deseable|insuficiente|deficiente|anos|hasta|inferior|mayor")
    mended = F.regexp_replace("text", r"(?i)\bS(?=[,.]?\d)", "5")
    shown = F.nullif(F.regexp_extract(mended, r"(?i)([\d.,]+\s*(?:-|a)\s*[\d.,]+|hasta\s*[\d.,]+|inferior\s*a\s*[\d.,]+|mayor\s*a\s*[\d.,]+)", 1), F.lit(""))
    said = F.nullif(F.regexp_extract("text", r"(?i)resultado\s*:?\s*([\d.,]+)", 1), F.lit(""))
    short = F.coalesce(*(F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in (r"(\d[\d.,]*)\s*%", r"%\s*(\d[\d.,]*)", r"(\d[\d.,]+)\s*[a-zA-Zµμ/°³⁶]+")))
    rows = rows.withColumn("told", F.when(result, said)).withColumn("loose", F.when(result & said.isNull(), _last_number(F.col("above"))).when(~label & ~result & ~limits & (F.length("text") < 40), short))
    rows = rows.withColumn("range", F.when(limits, _sound(shown))).withColumn("reference", F.when(F.col("range").isNotNull(), F.trim(mended)))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    out = rows.groupBy("doc", "block", "name").agg(F.min("place").alias("place"), last("told"), _first("loose").alias("loose"), last("range"), last("reference"))
    out = out.withColumn("raw", F.coalesce("told", "loose")).withColumn("value", parse_number(F.col("raw"), F.lit(""))).filter("value is not null")
    return _finished(out, "PERFIL", ("raw", "reference"))


def neo_rows(words: DataFrame) -> DataFrame:
    """Blocks under a heading that a line of the material follows: a result in words or numbers, its unit and limits.

    The number may stand on the line after a result in words. Lines that speak of limits are the reference.
    """
    rows = text_lines(words, "neo").withColumn("text", F.trim("text")).filter("text <> ''")
    rows = rows.withColumn("below", series.next_line("doc", ["place"], F.col("text")))
    begins = ~F.col("text").rlike(NEO_LABEL) & F.lower("below").startswith("material")
    rows = series.carry_forward(rows, "doc", ["place"], F.when(begins, F.col("text")), "name")
    rows = series.blocks(rows, "doc", ["place"], begins).filter("block > 0")
    said = F.when(F.lower("text").startswith("resultado"), F.trim(F.regexp_replace("text", r"(?i)^resultado\s*:?\s*", "")))
    word = F.nullif(F.regexp_extract(said, r"(?i)^(negativo|positivo|indeterminado)\b", 1), F.lit(""))
    rest = F.trim(F.regexp_replace(said, r"(?i)^(negativo|positivo|indeterminado)\b", ""))
    number = r"^([\d.,]+)\s*([^\d\s]+(?:/[^\d\s]+)?)?\s*(?:([\d.,]+)\s*a\s*([\d.,]+)\s*([^\d\s]+(?:/[^\d\s]+)?)?)?"
    part = lambda c, p, i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    after = r"^([\d.,]+)\s*([^\d\s]+(?:/[^\d\s]+)?)"
    rows = rows.withColumn("qual", F.initcap(word)).withColumn("own", part(rest, number, 1)).withColumn("next", F.when(said.isNotNull() & part(rest, number, 1).isNull(), part(F.col("below"), after, 1)))
    rows = rows.withColumn("raw", F.coalesce("own", "next", F.when(word.isNull(), rest)))
    unit = F.when(F.col("own").isNotNull(), F.coalesce(part(rest, number, 2), part(rest, number, 5))).otherwise(part(F.col("below"), after, 2))
    rows = rows.withColumn("unit", F.when(said.isNotNull(), unit)).withColumn("value", parse_number(F.coalesce("own", "next"), F.lit("")))
    rows = rows.withColumn("low", parse_number(part(rest, number, 3), F.lit(""))).withColumn("high", parse_number(part(rest, number, 4), F.lit("")))
    used = F.coalesce(series.previous_line("doc", ["place"], F.col("next")).isNotNull(), F.lit(False))
    speaks = F.lower("text").rlike("negativo|positivo|indeterminado|inferior|superior|intervalo") & ~F.lower("text").startswith("intervalo") & said.isNull()
    told = F.when(used, F.trim(F.regexp_replace("text", after, ""))).when(speaks & ~begins, F.col("text"))
    rows = rows.withColumn("reference", F.nullif(told, F.lit("")))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    parts = F.sort_array(F.collect_list(F.when(F.col("reference").isNotNull(), F.struct("place", "reference"))))
    out = rows.groupBy("doc", "block", "name").agg(F.min("place").alias("place"), *(last(c) for c in ("value", "raw", "unit", "low", "high", "qual")), F.array_join(F.transform(parts, lambda p: p["reference"]), " · ").alias("reference"))
    out = out.filter("value is not null or qual is not null")
    return out.select("doc", "place", F.lit("GENERAL").alias("section"), "name", "value", F.coalesce("raw", F.lit("")).alias("raw"), F.coalesce("unit", F.lit("")).alias("unit"), "low", "high", "reference", "qual")
