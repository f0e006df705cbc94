"""From parsed reports to stored rows: who they belong to, what is new, what waits for a decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serieslab.functions.dates import plain_timestamp
from serieslab.functions.numbers import common_unit, parse_number, parse_range, to_common
from serieslab.functions.text import clean_text, person_name, report_key
from serieslab.operators import dedup, joins, series

TEST = "struct<name:string,canonical:string,value:double,raw_result:string,unit:string,ref_low:double,ref_high:double,ref_text:string,flag:string,qual:string,method:string>"
SECTIONS = f"array<struct<name:string,tests:array<{TEST}>>>"


def resolve_persons(reports: DataFrame, persons: DataFrame) -> DataFrame:
    """``person_id`` of each report (name, doc): a known person, else a new number for each new name and document.

    New numbers follow the largest known one in the order of document and name.
    """
    named = reports.withColumn("name", person_name(F.col("name"))).withColumn("doc", F.coalesce("doc", F.lit("")))
    matched = joins.fuzzy_person(named, persons.select("id", "name", "doc"))
    top = persons.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = matched.filter("match_id is null").select("name", "doc").distinct()
    fresh = series.row_numbers(fresh, "_n", "doc", "name").select("name", "doc", (F.lit(top) + F.col("_n")).alias("new_id"))
    out = matched.join(fresh, ["name", "doc"], "left")
    return out.withColumn("created", F.col("match_id").isNull()).withColumn("person_id", F.coalesce("match_id", "new_id")).drop("match_id", "new_id")


def typed_tests(raw: DataFrame) -> DataFrame:
    """Rows of text (name, result, unit, reference) with number, range and common unit; rows without a value go."""
    unit = F.coalesce("unit", F.lit(""))
    out = raw.withColumn("name", F.trim(clean_text(F.col("name")))).withColumn("_v", parse_number(F.col("result"), unit)).withColumn("_r", parse_range(F.col("reference"), unit))
    qual = F.when(F.col("_v").isNull() & (F.trim("result") != ""), F.trim("result"))
    out = out.withColumn("value", to_common(F.col("_v"), unit)).withColumn("ref_low", to_common(F.col("_r.low"), unit)).withColumn("ref_high", to_common(F.col("_r.high"), unit))
    return out.withColumn("qual", qual).withColumn("unit", common_unit(unit)).drop("_v", "_r").filter("value is not null or qual is not null")


def ingest(reports: DataFrame, persons: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """New rows of reports: keyed by content, laboratory and date, with their person, without those already stored."""
    keyed = reports.withColumn("key", report_key(F.col("file_hash"), F.col("lab"), F.col("date").cast("string")))
    return dedup.new_reports(resolve_persons(keyed, persons), stored, force)


def staged_tests(pending: DataFrame) -> DataFrame:
    """Tests of staged reports (key, sections_json) as rows with their section and place."""
    sections = pending.select("key", F.posexplode(F.from_json("sections_json", SECTIONS)).alias("section_pos", "s"))
    return sections.select("key", "section_pos", F.col("s.name").alias("section"), F.posexplode("s.tests").alias("pos", "t")).select("key", "section_pos", "section", "pos", "t.*")


def carry_patient(reports: DataFrame) -> DataFrame:
    """Second and later reports of a file take date and patient from its first where they lack them."""
    w = Window.partitionBy("file_hash").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in ("date", "name", "doc"):
        reports = reports.withColumn(c, F.coalesce(c, F.first(c).over(w)))
    return reports


def text_entities(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Numbers of six to eight digits and runs of two to six capitalised words of a text, in order, each once."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"\b(\d{6,8})\b"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"((?:[A-Z][A-Z]+ ){1,5}[A-Z][A-Z]+)"), F.lit(1)))
    rows = texts.select(key, F.posexplode(found).alias("pos", "entity"))
    return rows.groupBy(key, "entity").agg(F.min("pos").alias("pos"))


def entity_persons(texts: DataFrame, key: str, text: str, persons: DataFrame) -> DataFrame:
    """Persons (id, name, doc) whose document or whole normal name is among the entities of a text: ``key``, entity, person_id."""
    found = text_entities(texts, key, text)
    by_doc = persons.filter("doc <> ''").groupBy(F.col("doc").alias("entity")).agg(F.min("id").alias("person_id"))
    by_name = persons.filter("name <> ''").groupBy(F.upper("name").alias("entity")).agg(F.min("id").alias("person_id"))
    known = by_doc.unionByName(by_name).groupBy("entity").agg(F.min("person_id").alias("person_id"))
    return found.select(key, "entity").join(known, "entity")


def person_detail(persons: DataFrame, reports: DataFrame, tests: DataFrame) -> DataFrame:
    """Each person with the number and dates of their reports, and of the tests in them, and the newest report.

    persons: id and more; reports: id, person_id, date; tests: report_id, value. Tests are summed by
    report before the join, reports by person, so nothing is counted twice.
    """
    per_report = tests.groupBy(F.col("report_id").alias("id")).agg(F.count(F.lit(1)).alias("n_tests"), F.count("value").alias("n_values"))
    with_tests = reports.join(per_report, "id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    per_person = with_tests.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_reports"), total("n_tests"), total("n_values"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max_by("id", F.struct("date", "id")).alias("newest_report"))
    out = persons.join(per_person.withColumnRenamed("person_id", "id"), "id", "left")
    return out.fillna(0, ["n_reports", "n_tests", "n_values"])


def ingest_flow(files: DataFrame, registry: DataFrame, reports: DataFrame, persons: DataFrame, stored: DataFrame) -> dict[str, DataFrame]:
    """A batch of scanned files and the reports read from them: what is stored, what waits, and the registry after it.

    files: path, sha1; registry: path, sha1; reports: file_hash, part, lab, date, name, doc, seq; stored: key,
    person_id, date, lab. Unchanged and duplicate files are left out. Reports take what they lack from
    the first of their file. Those of known persons, or with a document, are stored; others wait for
    a decision, with the name that was read.
    """
    status = dedup.file_status(files, registry)
    fresh = status.filter("status = 'new'").select(F.col("sha1").alias("file_hash")).distinct()
    read = carry_patient(reports.join(fresh, "file_hash", "left_semi"))
    keyed = read.withColumn("key", report_key(F.col("file_hash"), F.col("lab"), F.col("date").cast("string")))
    named = keyed.withColumn("doc", F.coalesce("doc", F.lit("")))
    matched = joins.fuzzy_person(named, persons.select("id", "name", "doc"))
    sure = F.col("match_id").isNotNull() | (F.col("doc") != "")
    new = dedup.new_reports(resolve_persons(matched.filter(sure).drop("match_id"), persons), stored)
    pending = matched.filter(~sure).select("key", F.col("name").alias("patient_name"), "doc", "lab", "date", "seq")
    pending = pending.join(stored.select("key").distinct(), "key", "left_anti").groupBy("key").agg(*(F.min_by(c, "seq").alias(c) for c in ("patient_name", "doc", "lab", "date")))
    after = registry.unionByName(files.join(registry.select("path"), "path", "left_anti").select(registry.columns))
    return {"stored": new, "pending": pending, "status": status, "registry": after}


def decide(pending: DataFrame, decisions: DataFrame, persons: DataFrame) -> DataFrame:
    """Staged reports after decisions (key, action, target_id, name): ``outcome`` and ``person_id``.

    cancel drops a report; approve and rename make a person, with the inferred or the given name;
    existing and current take ``target_id``, without which it is an error; a decision on a key that is
    not staged is not_found. New persons are numbered after the largest known id in the order of key.
    """
    joined = decisions.join(pending.select("key", "patient_name", "doc", F.lit(True).alias("_staged")), "key", "left")
    makes = F.col("action").isin("approve", "rename") & F.col("_staged")
    outcome = F.when(F.col("_staged").isNull(), "not_found").when(F.col("action") == "cancel", "cancelled").when(~makes & F.col("target_id").isNull(), "error").otherwise(F.col("action"))
    named = joined.withColumn("outcome", outcome).withColumn("person_name", F.when(makes, F.coalesce(F.nullif(F.trim(F.coalesce("name", F.lit(""))), F.lit("")), F.nullif(F.trim(F.coalesce("patient_name", F.lit(""))), F.lit("")), F.lit("DESCONOCIDO"))))
    top = persons.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = series.row_numbers(named.filter(makes), "_n", "key").select("key", (F.lit(top) + F.col("_n")).alias("_new"))
    kept = F.col("outcome").isin("approve", "rename", "existing", "current")
    return named.join(numbered, "key", "left").select("key", "action", "outcome", F.when(kept, F.coalesce("_new", "target_id")).alias("person_id"), "person_name")


def upload_summary(results: DataFrame) -> DataFrame:
    """Of batch results (person_id, status, new_reports): files, failures and new reports of each person."""
    ok = F.col("status") != "error"
    return results.groupBy("person_id").agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_errors"), F.coalesce(F.sum("new_reports"), F.lit(0)).alias("new_reports"))


def attachments(results: DataFrame) -> DataFrame:
    """Files of an upload that are kept as attachments: neither ingested as a report nor known already."""
    return results.filter((F.coalesce("new_reports", F.lit(0)) == 0) & ~F.col("status").isin("duplicate", "unchanged"))


def studies_to_analyse(documents: DataFrame, analyses: DataFrame, reports: DataFrame) -> DataFrame:
    """Documents without a finished analysis, leaving out PDFs that were read as reports."""
    done = analyses.filter("status = 'done'").select(F.col("document_id").alias("id"))
    parsed = reports.select("person_id", "stored_path").distinct().withColumn("kind", F.lit("pdf"))
    return documents.join(done, "id", "left_anti").join(parsed, ["person_id", "stored_path", "kind"], "left_anti")


# What identifies a person in a text, an identity number or a name in capitals.
NUMBER_SPAN, NAME_SPAN = r"\b(\d{6,8})\b", r"(?U)\b([A-ZÁÉÍÓÚÑ]{2,}(?:\s+[A-ZÁÉÍÓÚÑ]{2,}){1,5})\b"


def suggest_persons(texts: DataFrame, persons: DataFrame, read: DataFrame | None = None, aliases: DataFrame | None = None, most: int = 5) -> DataFrame:
    """Known persons whom texts may belong to, the likeliest first: key, place (from 1), person_id, match and entity.

    texts: key, person_id (whom a text is filed under, who is no candidate; may be null), text; persons:
    id, name, doc; ``aliases``: person_id, doc, further documents; ``read``: key, name, doc as a report's header has
    them, which come first. Numbers of six to eight digits are looked up as documents and runs of two
    to six words in capitals, accents and Ñ among them, on one line or more, as names: the person with the
    smallest id that has the same given name and three tokens in common (:func:`joins.fuzzy_person`). Documents
    come before names, both in the order of the text; a person counts once, and ``most`` a text are returned, which is the
    feature. A header counts by its document, else by that without its dots, else by its name. Null and
    empty texts have no candidates.

    Distinct entities alone are matched, by equality and by rare tokens; a text's rows are few.
    """
    spans = [F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in (NUMBER_SPAN, NAME_SPAN)]
    dealt = texts.select("key", "text").repartition("key")  # a search takes far longer than a text takes to move, and a file of texts may be one task
    parts = [dealt.select("key", F.lit(k + 1).alias("kind"), F.posexplode(s).alias("pos", "entity")) for k, s in enumerate(spans)]
    found = parts[0].unionByName(parts[1])
    if read is not None:
        row = lambda kind, pos, entity: F.struct(F.lit(kind).alias("kind"), F.lit(pos).alias("pos"), entity.alias("entity"))
        own = F.array(row(1, -3, F.col("doc")), row(0, -2, F.replace("doc", F.lit("."), F.lit(""))), row(2, -1, F.col("name")))
        found = found.unionByName(read.select("key", F.inline(own)).filter("entity <> ''"))
    docs = persons.select("doc", "id")
    if aliases is not None:
        docs = docs.unionByName(aliases.select("doc", F.col("person_id").alias("id")))
    each = F.array(F.struct(F.lit(1).alias("kind"), F.col("doc").alias("entity")), F.struct(F.lit(0).alias("kind"), F.replace("doc", F.lit("."), F.lit("")).alias("entity")))
    by_doc = docs.filter("doc <> ''").select("id", F.inline(each)).groupBy("kind", "entity").agg(F.min("id").alias("found"))
    names = found.filter("kind = 2").select(F.col("entity").alias("name"), F.lit("").alias("doc")).distinct()
    by_name = joins.fuzzy_person(names, persons.select("id", "name", "doc")).filter("match_id is not null").select(F.col("name").alias("entity"), F.col("match_id").alias("found"))
    known = by_doc.unionByName(by_name.select(F.lit(2).alias("kind"), "entity", "found"))
    hits = found.join(known, ["kind", "entity"])
    # of a header only its first way to find somebody counts; its hits stand before those of the text
    hits = hits.withColumn("rank", F.struct(F.when(F.col("pos") < 0, 0).otherwise(F.col("kind")).alias("k"), "pos"))
    first = hits.groupBy("key").agg(F.min(F.when(F.col("pos") < 0, F.col("pos"))).alias("header"))
    hits = hits.join(first, "key").filter("pos >= 0 or pos = header").drop("header")
    hits = hits.join(texts.select("key", "person_id"), "key").filter("person_id is null or person_id <> found")
    once = hits.groupBy("key", "found").agg(F.min(F.struct("rank", "kind", "entity")).alias("h"))
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("h.rank"))).filter(F.col("place") <= most)
    return placed.select("key", "place", F.col("found").alias("person_id"), F.when(F.col("h.kind") < 2, "documento").otherwise("nombre").alias("match"), F.col("h.entity").alias("entity"))


def nested(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """``parents`` with an array of structs for each child table (its rows, the column with the parent's key, the columns to sort by); empty without rows.

    Each child is grouped by the parent's key, and the joins are by the same key, so every table is
    shuffled once. Children of one parent are few by nature.
    """
    out = parents
    for name, (rows, of, order) in children.items():
        rest = [c for c in rows.columns if c != of and c not in order]
        listed = rows.groupBy(F.col(of).alias(key)).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
        out = out.join(listed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(dict(listed.dtypes)[name])))
    return out


def person_view(persons: DataFrame, reports: DataFrame, tests: DataFrame, medicines: DataFrame, documents: DataFrame, analyses: DataFrame, written: DataFrame) -> DataFrame:
    """All that is stored of each person in one row: reports with their tests, medicines, documents with their analyses, and what is new.

    persons: id and more; reports: id, person_id, date, stored_path and more; tests: report_id, pos and
    more; medicines: person_id, pos and more; documents: id, person_id, kind, stored_path, uploaded_at (a text) and
    more; analyses: document_id, created_at and more; ``written``: person_id, created_at of written reports.
    ``is_parsed_lab`` marks PDF documents that are stored as a report of the person. ``new_info`` has
    whether documents came after the last written report, how many and when that was; without one
    nothing is new.
    """
    with_tests = nested(reports, "id", {"tests": (tests, "report_id", ["pos"])})
    parsed = reports.filter("stored_path <> ''").select("person_id", "stored_path").distinct().withColumn("parsed", F.lit(True))
    docs = documents.join(parsed, ["person_id", "stored_path"], "left").withColumn("is_parsed_lab", (F.col("kind") == "pdf") & F.col("parsed").isNotNull()).drop("parsed")
    docs = nested(docs, "id", {"analyses": (analyses, "document_id", ["created_at"])})
    last = written.groupBy(F.col("person_id").alias("id")).agg(F.max("created_at").alias("last_report"))
    out = nested(persons, "id", {"reports": (with_tests, "person_id", ["date", "id"]), "medicines": (medicines, "person_id", ["pos"]), "documents": (docs, "person_id", ["uploaded_at", "id"])})
    out = out.join(last, "id", "left")
    fresh = F.filter("documents", lambda d: plain_timestamp(d["uploaded_at"]) > plain_timestamp(F.col("last_report")))
    count = F.when(F.coalesce("last_report", F.lit("")) != "", F.size(fresh)).otherwise(0)
    return out.withColumn("new_info", F.struct((count > 0).alias("has_new"), count.alias("count"), "last_report")).drop("last_report")
