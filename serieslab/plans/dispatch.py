"""Documents of mixed layouts: which layout each has, its header, and its rows of results in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieslab.functions.dates import parse_date
from serieslab.functions.numbers import parse_number, parse_range
from serieslab.functions.text import clean_text, detect_layout, norm_text, person_name
from serieslab.operators import series
from serieslab.plans import blocks, layout
from serieslab.session import shared_folder_of, stored, tasks_of

# What a layout's laboratory is called.
LABS = {"verdejo": "Laboratorio", "brunelli": "Brunelli", "curie": "Curie", "ypacarai": "Ypacarai", "sanacoop": "Sanacoop", "sanisidro": "Sanisidro", "neo": "Neo Diagnósticos", "medvital": "Medvital"}
# Patterns of each field, in the order in which they are tried. Layouts with "first" have their header on the first page.
COMMON = {"age": [r"(?i)edad\s*:?\s*(\d{1,3})\s*a"], "sex": [r"(?i)sexo\s*:?\s*([MF])"]}
FIELDS = {
    "curie": {
        "patient": [r"(?i)paciente\s*:?\s*([^\n]+?)\s*(?:Edad:|\n|$)"], "document": [r"(?is):\s*(\d{6,})\s*\n.*?CI\s*N\s*[°ºÂ]", r"(?i)ci\s*n\s*[°ºÂ]?\s*\n\s*:?\s*(\d+)"],
        "date": [r"(?i)fecha\s+de\s+ingreso\s*:?\s*([\d/]+\s+[\d:]+)"], "order": [r"(?i)c[óo]digo\s*:?\s*(\d+)"], "doctor": [r"(?i)m[ée]dico\s*:?\s*([A-ZÁÉÍÓÚÑ. ]+)"],
    },
    "ypacarai": {"patient": [r"(?i)nombre\s+usuario\s*:?\s*([^\n]+)"], "sex": [], "date": [r"(?i)fecha\s*:?\s*([\d/]+)"]},
    "sanacoop": {"patient": [r"(?i)paciente\s*:?\s*([^\n]+)"], "document": [r"(?i)doc\.?\s*n[°º]?\s*:?\s*([\d-]+)"], "date": [r"(?i)fecha\s+de\s+(?:toma\s+de\s+)?muestra\s*:?\s*([\d/]+)", r"(?i)impreso\s*:?\s*([\d/]+)"]},
    "sanisidro": {"patient": [r"(?i)paciente\s*:?\s*([^\n]+?)\s*(?:Edad|\n|$)"], "document": [r"(?i)documento\s*:?\s*([\d.]+)"], "date": [r"(?i)fecha\s*:?\s*([\d/]+)"]},
    "medvital": {"patient": [r"(?i)paciente\s*:?\s*([^\n]+?)\s*(?:Sexo|\n|$)"], "age": [r"(?i)edad\s*:?\s*(\d{1,3})"], "document": [r"(?i)c\.?i\.?\s*n[°º]?\s*:?\s*(\d+)"], "date": [r"(?i)fecha\s*:?\s*([\d-]+)"], "order": [r"(?i)estudio\s*:?\s*([^\n]+)"]},
    "neo": {"patient": [r"(?i)paciente\s*:?\s*([^\n]+?)\s+doc\.?\s*n"], "sex": [r"(?i)sexo\s*:?\s*(masculino|femenino|[MF])"], "document": [r"(?i)doc\.?\s*n[°º]?\s*:?\s*([\d-]+)"], "date": [r"(?i)impreso\s*:?\s*([\d/]+\s*-?\s*[\d:]*)"]},
}
NEO_DATES = (r"(?i)toma\s+de\s+muestra\s*:?\s*([\d/]+\s*-?\s*[\d:]*)", r"(?i)firma\s*:?\s*([\d/]+\s*-?\s*[\d:]*)")
FIRST_PAGE = ("curie", "ypacarai", "verdejo", "brunelli")
#: Words that a task gathers into pages: they are dealt to tasks by page first, so none sorts all that its part of the input says.
WORDS_A_TASK = 1 << 18
#: Words of the pages, which are rows by then and so take less room, that a task routes and writes by layout.
WORDS_ROUTED_A_TASK = 1 << 20
# Labels of fields in headers of tables, and distances within a label and a value.
LABELS = {"paciente": "patient", "nombre": "patient", "documento": "document", "c i": "document", "c i nro": "document", "edad": "age", "fecha": "date", "fecha recep": "date", "fecha recepcion": "date", "medico": "doctor", "medico tratante": "doctor", "nro orden": "order", "cod orden": "order"}
LABEL_GAP, VALUE_GAP, ABOVE, MIDDLE = 40, 50, 3, 200
# Sections of tables, results in words, and tests of the table without junk.
SECTION = r"(?i)^(hemograma|quimica|perfil\s+\w+|electrolitos|coagulograma|orina|inmunologia|marcadores\s+tumorales|hisopado|panel\s+respiratorio|tipificacion|hemoglobina\s+glicada|serologia|hematologia|formula\s+\w+|indices\s+\w+|serie\s+\w+|examen\s+\w+|sedimento)\b"
QUALITIES = ("negativo", "positivo", "no detectable", "trazas", "neg", "pos")
SANISIDRO_TEST = r"(?i)^(gl[óo]bulos rojos|hematocrito|hemoglobina|gl[óo]bulos blancos|neutr[óo]filos segmentados|neutr[óo]filos en cayado|linfocitos|monocitos|eosin[óo]filos|chcm|plaquetas|vcm|hcm|pcr|glicemia|glucosa|leucocitos)\b"
SANISIDRO_SECTION = r"(?i)^(hematologia|serologia|quimica)"
#: Columns of a row of results.
ROW = ("doc", "place", "section", "name", "value", "raw", "unit", "low", "high", "reference", "qual", "method")


def page_texts(pages: DataFrame) -> DataFrame:
    """doc, page, text and words: pages (of :func:`layout.pages_of`) with the text of their lines; a page is a row all along, so nothing is shuffled."""
    said = lambda w, i: F.struct(F.get(w, F.lit(0))["y"].alias("y"), i.alias("line"), layout.said(F.sort_array(w)).alias("said"))
    text = F.array_join(F.transform(F.sort_array(F.transform("lines", said)), lambda x: x["said"]), "\n")
    return layout.lined(pages, 1.0).select("doc", "page", text.alias("text"), F.flatten("lines").alias("words")).withColumn("text", clean_text(F.col("text")))


def routed(words: DataFrame) -> DataFrame:
    """Pages of documents of words (doc, page, x, y, word) with the layout and the number of their report.

    Returns doc, page, text, words (of the page), part and layout. A document has the first layout whose
    marks occur in its text. One of Ypacaraí ends with its first page; if Sanacoop speaks on the
    pages after it, they are a second report of the same document.

    Routes are found from texts alone and are a small row a page. They meet the pages by document and page, so a document
    of many pages is no burden of one task, and pages are hashed against them, not sorted.
    """
    said = stored(words, "words")
    n = said.count()
    dealt = said.filter("doc is not null and page is not null").repartition(tasks_of(n, WORDS_A_TASK), "doc", "page")
    pages, few = stored(page_texts(layout.pages_of(dealt)), "pages"), tasks_of(n, WORDS_ROUTED_A_TASK)
    texts = pages.select("doc", "page", "text").repartition(few, "doc").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    whole = texts.withColumn("norm", norm_text(F.array_join(F.transform("p", lambda p: p["text"]), "\n"))).withColumn("found", detect_layout(F.col("norm")))
    more = F.exists(F.slice("p", F.lit(2), F.size("p")), lambda p: norm_text(p["text"]).rlike("sanacoop|neodiagnosticos|hemoglobina glicada"))
    numbered = norm_text(F.col("doc")).rlike("ord5|ord6") & ~F.col("found").isin("medvital", "brunelli")
    of = whole.select("doc", F.when(numbered, "curie").otherwise(F.col("found")).alias("layout"), more.alias("more"), F.posexplode("p.page").alias("i", "page"))
    second = (F.col("layout") == "ypacarai") & (F.col("i") > 0)
    routes = of.filter(~second | F.col("more")).select("doc", "page", second.cast("int").alias("part"), F.when(second, "sanacoop").otherwise(F.col("layout")).alias("layout"))
    return pages.repartition(few, "doc", "page").join(routes.repartition(few, "doc", "page").hint("shuffle_hash"), ["doc", "page"])


def _first(text: Column, patterns: list[str]) -> Column:
    tried = [F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns]
    return F.coalesce(*tried, F.lit(None).cast("string")) if tried else F.lit(None).cast("string")


def text_headers(pages: DataFrame) -> DataFrame:
    """Fields of headers that are written as text: doc, part, layout, patient, age, sex, document, date, order, doctor and notes."""
    first = pages.groupBy("doc", "part", "layout").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    texts = stored(first.select("doc", "part", "layout", F.when(F.col("layout").isin(*FIRST_PAGE), F.col("p")[0]["text"]).otherwise(joined).alias("t")), "header-texts")
    spoken = F.filter(F.split("t", "\n"), lambda x: F.lower(x).startswith("fecha y hora"))
    signed = F.array_min(F.filter(F.transform(spoken, lambda x: parse_date(F.translate(_first(x, list(NEO_DATES)), "-", " "))), lambda d: d.isNotNull()))
    out = None
    for of, fields in FIELDS.items():
        field = {n: _first(F.col("t"), fields.get(n, COMMON.get(n, []))) for n in ("patient", "age", "sex", "document", "date", "order", "doctor")}
        date = parse_date(F.translate(field["date"], "-", "/" if of == "medvital" else " "))
        own = texts.filter(F.col("layout") == of).select(
            "doc", "part", "layout", field["patient"].alias("patient"), field["age"].cast("int").alias("age"), F.upper(F.left(field["sex"], F.lit(1))).alias("sex"), F.btrim(field["document"], F.lit("- ")).alias("document"),
            (F.coalesce(signed, date) if of == "neo" else date).alias("date"), field["order"].alias("order"), field["doctor"].alias("doctor"), (F.trim("t") if of == "medvital" else F.lit(None).cast("string")).alias("notes"),
        )
        out = own if out is None else out.unionByName(own)
    return out


def _beside(words: list) -> list[tuple[str, str]]:
    """(label, value) of one line where the value stands to the right of a label that ends in a colon."""
    colons, labels, of = [i for i, w in enumerate(words) if w["word"].endswith(":")], set(), {}
    for c in colons:
        own, x = [words[c]["word"].rstrip(":")] if words[c]["word"] != ":" else [], words[c]["x"]
        if own:
            labels.add(c)
        for j in range(c - 1, -1, -1):
            if words[j]["word"].endswith(":") or x - words[j]["x"] > LABEL_GAP:
                break
            own.insert(0, words[j]["word"])
            labels.add(j)
            x = words[j]["x"]
        of[c] = " ".join(own)
    found = []
    for c in colons:
        value, x = [], words[c]["x"]
        for j in range(c + 1, len(words)):
            if words[j]["word"].endswith(":") or j in labels or words[j]["x"] - x > VALUE_GAP:
                break
            value.append(words[j]["word"])
            x = words[j]["x"]
        if value:
            found.append((of[c], " ".join(value)))
    return found


def table_headers(pages: DataFrame) -> DataFrame:
    """Fields of headers of tables: beside their labels (brunelli), or up to three points above them in the same half of the page (verdejo)."""
    own = pages.filter(F.col("layout").isin("verdejo", "brunelli"))
    first = own.withColumn("first", F.min("page").over(Window.partitionBy("doc", "part"))).filter("page = first")
    lined = layout.gathered(first, 1.0).select("doc", "line", "y", F.transform("w", lambda v: F.struct(v["x"].alias("x"), v["word"].alias("word"))).alias("w"))
    lined = stored(lined.join(first.select("doc", "layout"), "doc"), "header-lines")
    beside = F.udf(_beside, "array<struct<label string, value string>>", useArrow=True)
    right = lined.filter("layout = 'brunelli'").select("doc", F.col("line").alias("place"), F.posexplode(beside("w")).alias("i", "f"))
    right = right.select("doc", F.struct("place", "i").alias("at"), F.col("f.label").alias("label"), F.col("f.value").alias("value"))

    left = lined.filter("layout = 'verdejo'")
    word = lambda w, i: F.get(w, i)["word"]
    ends = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: word(F.col("w"), i).endswith(":") & (i > 0))
    tags = left.select("doc", "y", "line", "w", F.explode(ends).alias("i")).select("doc", "y", "line", "i", F.get("w", F.col("i"))["x"].alias("x"), word(F.col("w"), F.col("i") - 1).alias("label"), F.lower(word(F.col("w"), F.col("i") - 2)).alias("before"), F.lower(word(F.col("w"), F.col("i") + 1)).alias("after"))
    label = F.lower("label")
    tags = tags.filter((label.isin("paciente", "documento", "edad", "fecha", "medico") & ~((label == "paciente") & F.coalesce(F.col("before") == "tipo", F.lit(False)))) | (label.isin("cod.", "nro.") & (F.col("after") == "orden")))
    over = left.select("doc", F.col("y").alias("py"), "w")
    met = tags.join(over, "doc").filter((F.col("py") < F.col("y")) & (F.col("y") - F.col("py") <= ABOVE)).groupBy("doc", "line", "i", "x", "label").agg(F.min_by("w", "py").alias("w"))
    same = F.filter("w", lambda v: (v["x"] < MIDDLE) == (F.col("x") < MIDDLE))
    value = F.array_join(F.transform(same, lambda v: v["word"]), " ")
    above = met.withColumn("value", value).filter("value <> ''").select("doc", F.struct((-F.col("line")).alias("place"), (-F.col("i")).alias("i")).alias("at"), F.when(label.isin("cod.", "nro."), "cod orden").otherwise(F.col("label")).alias("label"), "value")

    keys = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    found = right.unionByName(above).withColumn("field", keys[norm_text(F.col("label"))]).filter("field is not null")
    wide = found.groupBy("doc").pivot("field", ["patient", "document", "age", "date", "doctor", "order"]).agg(F.min_by("value", "at"))
    top = own.groupBy("doc", "part", "layout").agg(F.min_by("text", "page").alias("t"))
    named = F.nullif(F.trim(F.regexp_extract("t", r"([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ .']+)\s*(?:\n|$)", 1)), F.lit(""))
    signs = F.nullif(F.trim(F.regexp_replace(F.regexp_extract("t", r"(?m)^((?:Dra?\.|Bioq\.|Lic\.|Q\.F\.)[^\n]+)$", 1), r"(?i)\bReg\.?\s*Prof\.?.*$", "")), F.lit(""))
    lettered = F.when(F.col("doctor").rlike("[A-Za-zÁÉÍÓÚÑáéíóúñ]"), F.col("doctor"))
    return top.join(wide, "doc", "left").select(
        "doc", "part", "layout", F.coalesce(F.when(person_name(F.col("patient")) != "", F.col("patient")), named).alias("patient"), F.nullif(F.regexp_extract("age", r"(\d{1,3})", 1), F.lit("")).cast("int").alias("age"),
        F.lit(None).cast("string").alias("sex"), "document", parse_date(F.col("date")).alias("date"), "order", F.coalesce(lettered, F.when(F.col("layout") == "verdejo", signs)).alias("doctor"), F.lit(None).cast("string").alias("notes"),
    )


def tabular_rows(words: DataFrame, of: str) -> DataFrame:
    """Rows of a table of results. What stands on lines without a name belongs to the next row that has no reference or method of its own.

    Rows begin after the line that heads the columns; addresses and footers are left out; a section holds until the next one.
    """
    tolerance, ends = layout.bands(of)
    rows = layout.cells(layout.gathered(words, tolerance), ends)
    key = norm_text(layout.said(F.col("w")))
    heads = (key == "analisis") | key.startswith("analisis ") if of == "brunelli" else key.contains("determinaciones") | (key.contains("resultados") & key.contains("unidad"))
    whole = Window.partitionBy("doc")
    rows = rows.withColumn("heads", heads).withColumn("top", F.col("page") == F.min("page").over(whole)).withColumn("start", F.min(F.when(F.col("top") & F.col("heads"), F.col("y"))).over(whole))
    below = ~F.col("top") | F.col("start").isNull() | (F.col("y") >= F.col("start") + 1)
    rows = rows.filter(below & ~((F.col("name") != "") & blocks.is_junk_row(F.col("name")))).withColumn("place", F.col("page") * 100000 + F.col("line"))
    few = (F.size(F.split("name", r"\s+")) <= 4) & ~F.col("name").rlike(r"\d") & (F.col("result") == "") & (F.col("reference") == "")
    rows = rows.withColumn("heading", few & F.col("name").rlike(SECTION))
    rows = series.carry_forward(rows, "doc", ["place"], F.when(F.col("heading"), F.col("name")), "section")
    rows = series.blocks(rows, "doc", ["place"], F.col("name") != "")
    said = lambda c, where: F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(where & (F.col(c) != ""), F.struct("place", c)))), lambda x: x[c]), " ")).alias(f"more_{c}")
    # a block is a row with a name, if it isn't the first, and the lines without one after it; these are the next block's
    own, named = ("place", "section", "name", "result", "unit", "method", "reference"), F.col("name") != ""
    rows = rows.groupBy("doc", "block").agg(F.max(F.when(named, F.struct("heading", *own))).alias("r"), *(said(c, ~named) for c in ("method", "reference")))
    after = Window.partitionBy("doc").orderBy("block")
    rows = rows.withColumn("more_method", F.lag("more_method").over(after)).withColumn("more_reference", F.lag("more_reference").over(after))
    rows = rows.filter("r is not null and not r.heading").select("doc", *(f"r.{c}" for c in own), "more_method", "more_reference")
    reference, method = (F.coalesce(F.nullif(c, F.lit("")), f"more_{c}", F.lit("")) for c in ("reference", "method"))
    plain = F.regexp_replace("unit", r"(?i)10e[0-9]+|10³|10⁶|x10[³⁶]?|mm3|/ul|/µl|/μl", "") if of == "brunelli" else F.col("unit")
    value, limits = parse_number(F.col("result"), plain), parse_range(reference, plain)
    qual = F.when(value.isNull() & norm_text(F.col("result")).isin(*QUALITIES), F.col("result"))
    out = rows.select("doc", "place", F.coalesce("section", F.lit("GENERAL")).alias("section"), "name", value.alias("value"), F.col("result").alias("raw"), "unit", limits["low"].alias("low"), limits["high"].alias("high"), reference.alias("reference"), qual.alias("qual"), method.alias("method"))
    return out.filter("value is not null or qual is not null")


def sanisidro_rows(words: DataFrame) -> DataFrame:
    """Rows of named tests; what is said of limits in the column of units is the reference if there is none."""
    tolerance, ends = layout.bands("sanisidro")
    rows = layout.cells(layout.gathered(words, tolerance), ends).withColumn("place", F.col("page") * 100000 + F.col("line"))
    rows = series.carry_forward(rows, "doc", ["place"], F.nullif(F.regexp_extract("name", SANISIDRO_SECTION, 1), F.lit("")), "section")
    test, limits = F.regexp_extract("name", SANISIDRO_TEST, 1), parse_range(F.col("method"), F.lit(""))
    speaks = F.col("unit").rlike("(?i)deseable|inferior|hasta|menor|mayor|superior|rango|referencia")
    given = F.when(limits["low"].isNotNull() | limits["high"].isNotNull(), F.col("method"))
    reference = F.coalesce(given, F.when(speaks, F.col("unit")), F.lit(""))
    unit = F.when(speaks, F.coalesce(blocks.unit_in(F.col("unit")), F.lit(""))).otherwise(F.col("unit"))
    out = rows.filter(test != "").select("doc", "place", F.coalesce("section", F.lit("HEMATOLOGIA")).alias("section"), test.alias("name"), parse_number(F.col("result"), F.col("unit")).alias("value"), F.col("result").alias("raw"), unit.alias("unit"), limits["low"].alias("low"), limits["high"].alias("high"), reference.alias("reference"), F.lit(None).cast("string").alias("qual"), F.lit("").alias("method"))
    return out.filter("value is not null")


ROWS = {"verdejo": lambda w: tabular_rows(w, "verdejo"), "brunelli": lambda w: tabular_rows(w, "brunelli"), "sanisidro": sanisidro_rows, "curie": blocks.curie_rows, "ypacarai": blocks.ypacarai_rows, "sanacoop": blocks.sanacoop_rows, "neo": blocks.neo_rows}


def routed_pages(words: DataFrame) -> dict[str, DataFrame]:
    """Pages of :func:`routed` by layout, written once, so each layout's rules read their own documents only."""
    pages = routed(words)
    folder = shared_folder_of(pages, "routed-pages", "layout")
    return {of: pages.sparkSession.read.schema(pages.schema).parquet(folder).filter(F.col("layout") == of) for of in LABS}


def read_reports(routes: dict[str, DataFrame]) -> DataFrame:
    """Reports of pages by layout (:func:`routed_pages`), as :func:`read_documents` describes them."""
    pages = reduce(DataFrame.unionByName, (routes[of] for of in FIELDS))
    headers = text_headers(pages).unionByName(table_headers(routes["verdejo"].unionByName(routes["brunelli"])))
    first = headers.filter("part = 0").select("doc", F.col("date").alias("d"), F.col("patient").alias("p"))
    reports = headers.join(first, "doc", "left").withColumn("date", F.coalesce("date", F.when(F.col("part") > 0, F.col("d"))))
    reports = reports.withColumn("patient", F.coalesce("patient", F.when(F.col("part") > 0, F.col("p")))).drop("d", "p")
    labs = F.create_map(*(F.lit(x) for kv in LABS.items() for x in kv))
    return reports.select("doc", "part", "layout", labs[F.col("layout")].alias("lab"), "patient", person_name(F.coalesce("patient", F.lit(""))).alias("name"), "age", "sex", "document", "date", "order", "doctor", (F.col("layout") == "medvital").alias("is_document"), "notes")


def read_rows(routes: dict[str, DataFrame]) -> DataFrame:
    """Rows of results of pages by layout (:func:`routed_pages`), as :func:`read_documents` describes them."""
    rows = None
    for of, read in ROWS.items():
        part = routes[of].withColumn("doc", F.concat_ws(":", "part", "doc"))  # reports of one document stay apart
        found = read(part.select("doc", "page", "words"))
        found = found.withColumn("method", F.lit("")) if "method" not in found.columns else found
        found = found.select(*ROW).withColumn("layout", F.lit(of))
        rows = found if rows is None else rows.unionByName(found)
    place = F.locate(":", F.col("doc"))
    return rows.select(F.expr("substring(doc, locate(':', doc) + 1)").alias("doc"), F.substr("doc", F.lit(1), place - 1).cast("int").alias("part"), "layout", *ROW[1:])


def read_documents(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports and rows of results of documents of any layout: words (doc, page, x, y, word) to typed tables.

    Reports: doc, part, layout, lab, patient (as read), name, age, sex, document, date, order, doctor,
    is_document and notes. A study of Medvital is a document: it has its text as notes and no rows. A second report of a
    document takes date and patient from the first where it has none. Rows: doc, part, layout, place, section,
    name, value, raw, unit, low, high, reference, qual, method. A document without words is not known.

    Pages with their words are written once by layout, and both tables are read from them;
    no step holds more than a page.
    """
    routes = routed_pages(words)
    return read_reports(routes), read_rows(routes)
