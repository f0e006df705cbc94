"""Texts about persons: sections of lines put together to what a writer is given, and written reports kept and read again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.functions.numbers import short_number

# What a section says that has no lines.
NO_MEDICINES, NO_INTERACTIONS, NO_STUDIES = "- Ninguno registrado", "- Ninguna interacción detectada por el sistema.", "- Sin estudios de imagen analizados"


def shown_value(value: Column, unit: Column, low: Column, high: Column) -> Column:
    """A value with its unit and the limits that it has."""
    limits = F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit(" (ref: "), short_number(low), F.lit("-"), short_number(high), F.lit(")"))).when(high.isNotNull(), F.concat(F.lit(" (ref: <"), short_number(high), F.lit(")"))).when(low.isNotNull(), F.concat(F.lit(" (ref: >"), short_number(low), F.lit(")")))
    return F.concat(short_number(value), F.lit(" "), F.coalesce(unit, F.lit("")), F.coalesce(limits, F.lit("")))


def marker_line(m: DataFrame) -> Column:
    """Label, value and limits, status in capitals unless normal, trend, number of measurements, last day."""
    status = F.when(F.col("status").isin("alto", "bajo"), F.upper("status")).otherwise(F.col("status"))
    trend = F.when(F.col("trend") != "", F.concat(F.lit(" · tendencia: "), "trend"))
    day = F.date_format("last_date", "yyyy-MM-dd")
    return F.concat(F.lit("- "), "label", F.lit(": "), shown_value(F.col("value"), F.col("unit"), F.col("low"), F.col("high")), F.lit(" -> "), status, F.coalesce(trend, F.lit("")), F.lit(" ("), F.col("n").cast("string"), F.lit(" mediciones), última "), F.coalesce(day, F.lit("")))


def medicine_line(dose: Column, frequency: Column) -> Column:
    part = lambda c, a, b: F.coalesce(F.when(c != "", F.concat(F.lit(a), c, F.lit(b))), F.lit(""))
    return F.concat(F.lit("- "), "name", part(dose, " ", ""), part(frequency, " (", ")"))


def section(rows: DataFrame, name: str, line: Column, *order: Column, most: int | None = None) -> DataFrame:
    """person_id and ``name``: the lines of each person in order, at most ``most``; what one person has is short."""
    listed = F.array_sort(F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), line.alias("line"))))
    lines = F.transform(listed, lambda x: x["line"])
    return rows.groupBy("person_id").agg(F.array_join(F.slice(lines, 1, most) if most else lines, "\n").alias(name))


def assembled(persons: DataFrame, sections: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """``text`` of each person (person_id): sections (rows of :func:`section`, their column, heading, words if it is empty), in turn."""
    out = reduce(lambda df, s: df.join(s[0], "person_id", "left"), sections, persons)
    parts = [F.concat(F.lit(f"{heading}:\n"), F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(none))) for _, name, heading, none in sections]
    return out.withColumn("text", F.concat_ws("\n\n", *parts)).drop(*(s[1] for s in sections))


def read_through(wanted: DataFrame, stored: DataFrame, written: DataFrame) -> DataFrame:
    """The report of each wanted person, and ``source``: stored, written, stale or none.

    wanted: person_id, newest (time of the newest data); stored: person_id, text, made_at; written:
    person_id, text (null where writing failed). A stored report that is not older than the data is
    taken; else the newly written one; if that failed, the stored one all the same, as stale.
    """
    old = stored.groupBy("person_id").agg(F.max_by("text", "made_at").alias("_old"), F.max("made_at").alias("_at"))
    new = written.filter("text is not null").groupBy("person_id").agg(F.min("text").alias("_new"))
    out = wanted.join(old, "person_id", "left").join(new, "person_id", "left")
    current = F.coalesce(F.col("_at") >= F.col("newest"), F.lit(False)) & F.col("_old").isNotNull()
    source = F.when(current, "stored").when(F.col("_new").isNotNull(), "written").when(F.col("_old").isNotNull(), "stale").otherwise("none")
    text = F.when(current, F.col("_old")).otherwise(F.coalesce("_new", "_old"))
    return out.select("person_id", text.alias("text"), source.alias("source"))
