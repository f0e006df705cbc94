"""Numbers, ranges, units and strengths in Spanish-American notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of counts, whose dots and commas are thousands marks; the scaled ones keep a decimal comma.
BIG_UNITS = ("/ul", "/µl", "/μl", "10e3", "10e6", "x10", "mm3", "10³", "10⁶", "10e9", "por ul", "por µl")
SCALED = ("10e3", "10e6", "10³", "10⁶")
#: Taken for a count's unit too, unless ``corrected`` is asked for.
ENZYME_UNIT = "u/l"


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def parse_number(text: Column, unit: Column, corrected: bool = False) -> Column:
    """The last number of a text, whose blanks are dropped first ("1 234" is 1234); null if it is none.

    In a count's unit dots and commas are thousands marks; in a scaled one, or in others, the
    rightmost of both kinds is the decimal mark. ``corrected`` keeps U/L from counting as a count.
    """
    u = F.lower(F.coalesce(unit, F.lit("")))
    raw = F.try_element_at(F.regexp_extract_all(F.translate(text, " \u00a0", ""), F.lit(r"(\d[\d.,]*)"), F.lit(1)), F.lit(-1))
    dots, commas = raw.contains("."), raw.contains(",")
    swapped = F.translate(F.translate(raw, ".", ""), ",", ".")
    scaled = _any(u, SCALED)
    as_scaled = F.when(dots & commas, swapped).when(commas, F.translate(raw, ",", ".")).otherwise(raw)
    comma_last = F.length(F.substring_index(raw, ",", -1)) < F.length(F.substring_index(raw, ".", -1))
    other = F.when(dots & commas, F.when(comma_last, swapped).otherwise(F.translate(raw, ",", ""))).when(commas, F.translate(raw, ",", ".")).otherwise(raw)
    big = _any(u, BIG_UNITS if corrected else (*BIG_UNITS, ENZYME_UNIT))
    return F.when(big & ~scaled, F.translate(raw, ".,", "")).when(big, as_scaled).otherwise(other).try_cast("double")


def parse_range(text: Column, unit: Column, corrected: bool = False) -> Column:
    """struct<low, high> of a reference text: two numbers, else its last upper limit, else its last lower limit."""
    t = F.regexp_replace(text, r",\s+(\d)", r",$1")
    both = r"([\d.,]+)\s*(?:[-−–—]|a)\s*([\d.,]+)"
    low, high = F.regexp_extract(t, both, 1), F.regexp_extract(t, both, 2)
    last = lambda words: F.try_element_at(F.regexp_extract_all(t, F.lit(rf"(?i)(?:{words})\s*([\d.,]+)"), F.lit(1)), F.lit(-1))
    upper, lower = last(r"hasta|inferior\s*a|menor\s*a|menor|<"), last(r"mayor\s*a|superior\s*a|mayor|superior|>")
    pair = lambda a, b: F.struct(a.cast("string").alias("low"), b.cast("string").alias("high"))
    # limits are chosen as texts and each is parsed once: what a branch holds is worked out again wherever it is named
    said = F.when(low != "", pair(low, high)).when(upper.isNotNull(), pair(F.lit(None), upper)).otherwise(pair(lower, F.lit(None)))
    return F.struct(*(parse_number(said[n], unit, corrected).alias(n) for n in ("low", "high")))


def unit_factor(unit: Column) -> Column:
    """What a value in a scaled count unit is multiplied by."""
    u = F.translate(F.lower(F.coalesce(unit, F.lit(""))), " ", "")
    thousand = _any(u, ("10e3/", "10³/", "x103/"))
    million = _any(u, ("10e6/", "10⁶/", "x106/"))
    return F.when(thousand, 1000.0).when(million, 1e6).otherwise(1.0)


def common_unit(unit: Column) -> Column:
    u = F.translate(F.lower(F.coalesce(unit, F.lit(""))), " ", "")
    return F.when((unit_factor(unit) > 1) | u.isin("/ul", "/µl", "/μl", "/l"), F.lit("/µL")).otherwise(F.trim(F.coalesce(unit, F.lit(""))))


def to_common(value: Column, unit: Column) -> Column:
    """A value in its common unit, rounded half-even to six places."""
    return F.when(unit_factor(unit) > 1, F.bround(value * unit_factor(unit), 6)).otherwise(value)


def clean_unit(unit: Column) -> Column:
    """The unit at the end of a text that a reference range leaked into; a known misspelling is mended."""
    polluted = (F.length(unit) > 12) | unit.rlike(r"(?i)deseable|inferior|hasta|menor\s*a|mayor\s*a|superior\s*a|rango|referencia")
    tail = F.regexp_extract(unit, r"(\S*[A-Za-zµμ%][A-Za-z0-9³⁶]*(?:\s*/\s*[A-Za-zµμ0-9³]+)?)$", 1)
    return F.trim(F.regexp_replace(F.when(polluted, tail).otherwise(F.coalesce(unit, F.lit(""))), "md/d[Ll]", "mg/dL"))


def es_number(c: Column, places: int) -> Column:
    """A number with ``places`` decimals, dots for thousands and a decimal comma."""
    return F.translate(F.format_number(c, places), ",.", ".,")


def short_number(c: Column) -> Column:
    """At most three decimals, none at the end that are zero, Spanish marks."""
    return F.regexp_replace(F.regexp_replace(es_number(c, 3), "0+$", ""), ",$", "")


def range_meter(v: Column, low: Column, high: Column) -> Column:
    """Percent of a scale on which the reference range spans 18 to 82, held within 2 and 98."""
    return F.when(high > low, F.greatest(F.lit(2.0), F.least(F.lit(98.0), 18.0 + (v - low) / (high - low) * 64.0)))


def range_tooltip(text: Column, low: Column, high: Column, unit: Column) -> Column:
    """The reference text, else what the limits say, else an empty text."""
    u = F.coalesce(unit, F.lit(""))
    says = lambda *parts: F.trim(F.concat(F.lit("Rango deseado: "), *parts, F.lit(" "), u))
    own = F.trim(F.coalesce(text, F.lit("")))
    return (
        F.when((own != "") & (own != "-"), own)
        .when(low.isNotNull() & high.isNotNull(), says(short_number(low), F.lit(" – "), short_number(high)))
        .when(high.isNotNull(), says(F.lit("inferior a "), short_number(high)))
        .when(low.isNotNull(), says(F.lit("superior a "), short_number(low)))
        .otherwise("")
    )


def bmi(weight_kg: Column, height_cm: Column) -> Column:
    return F.round(weight_kg / F.pow(height_cm / 100.0, F.lit(2.0)), 1)


# The units of a strength, as written and as shown.
STRENGTH = r"(?i)(\d+(?:[.,]\d+)?(?:\s*/\s*\d+(?:[.,]\d+)?)?)\s*(mg\s*/\s*ml|mcg\s*/\s*ml|microgramas?|microgramos?|miligramas?|miligramos?|gramas?|gramos?|mcg|mg|µg|ug|g|ui|u\.i\.|%)"
#: Lists harvested abroad also give volumes and spell units out; there a dot never marks thousands.
STRENGTH_ABROAD = r"(?i)(\d+(?:[.,]\d+)?(?:\s*/\s*\d+(?:[.,]\d+)?)?)\s*(mg\s*/\s*ml|mcg\s*/\s*ml|ui\s*/\s*ml|microgramos?|miligramos?|gramos?|mcg|mg|µg|ug|g|unidades|ui|u\.i\.|%|ml)"


def _strength_unit(unit: Column) -> Column:
    u = F.translate(F.lower(unit), " ", "")
    return F.when(u.rlike("^microgram") | u.isin("µg", "ug"), "mcg").when(u.rlike("^miligram"), "mg").when(u.rlike("^gram"), "g").when(u.isin("ui", "u.i.", "unidades"), "UI").otherwise(u)


def strengths(text: Column, abroad: bool = False) -> Column:
    """array<struct<unit, value, label>> of the strengths in a product name, first of equal labels kept.

    At home three digits after a dot are thousands; of a ratio the first number counts. Values outside
    (0, 100000] are left out. Labels have a decimal comma, and no decimals for whole numbers.
    """
    pattern = F.lit(STRENGTH_ABROAD if abroad else STRENGTH)
    raws, units = (F.regexp_extract_all(text, pattern, F.lit(i)) for i in (1, 2))

    def one(raw: Column, unit: Column) -> Column:
        raw = F.translate(raw, " ", "")
        head = F.substring_index(raw, "/", 1)
        thousands = F.lit(False) if abroad else head.rlike(r"^\d{1,3}\.\d{3}$")
        value = F.when(thousands, F.translate(head, ".", "")).otherwise(F.translate(head, ",", ".")).try_cast("double")
        shown = F.when(raw.contains("/"), F.translate(raw, ".", ",")).when(value == F.floor(value), value.cast("long").cast("string")).otherwise(F.translate(value.cast("string"), ".", ","))
        unit = _strength_unit(unit)
        return F.struct(unit.alias("unit"), value.alias("value"), F.concat(shown, F.lit(" "), unit).alias("label"))

    found = F.filter(F.zip_with(raws, units, one), lambda s: (s["value"] > 0) & (s["value"] <= 100000))
    return F.array_distinct(found)


def strength_labels(text: Column, abroad: bool = False) -> Column:
    """Labels of :func:`strengths`, ordered by unit and value."""
    return F.transform(F.array_sort(strengths(text, abroad)), lambda s: s["label"])
