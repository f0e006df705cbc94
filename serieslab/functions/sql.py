"""The library's functions for SQL users."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from serieslab.functions.numbers import STRENGTH
from serieslab.functions.text import ACCENTED, PLAIN

#: Scalar functions as SQL expressions, which the optimizer sees through: name, arguments, type, body.
SCALARS = (
    ("norm_text", "s STRING", "STRING", f"trim(regexp_replace(lower(regexp_replace(translate(s, '{ACCENTED}', '{PLAIN}'), '[^\\\\x00-\\\\x7F]', '')), '[^a-z0-9]+', ' '))"),
    ("flag_of", "v DOUBLE, low DOUBLE, high DOUBLE", "STRING", "CASE WHEN v IS NULL OR (low IS NULL AND high IS NULL) THEN '' WHEN v < low THEN 'L' WHEN v > high THEN 'H' ELSE 'N' END"),
    ("status_of", "v DOUBLE, low DOUBLE, high DOUBLE", "STRING", "CASE WHEN v IS NULL THEN 'no_realizado' WHEN v < low THEN 'bajo' WHEN v > high THEN 'alto' ELSE 'normal' END"),
    ("trend_of", "v DOUBLE, previous DOUBLE", "STRING", "CASE WHEN v IS NULL OR previous IS NULL THEN '' WHEN abs(v - previous) < 1e-9 THEN 'estable' WHEN v > previous THEN 'subiendo' ELSE 'bajando' END"),
    ("range_meter", "v DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN high > low THEN greatest(2D, least(98D, 18 + (v - low) / (high - low) * 64)) END"),
)


@F.udtf(returnType="amount string, unit string")
class ExtractStrengths:
    """Strengths in a product name as they are written, one row each."""

    def eval(self, name: str) -> Iterator[tuple]:
        yield from re.findall(STRENGTH, name or "")


@F.udtf(returnType="id string")
class ExtractIds:
    """Numbers of six to eight digits in a text, each once, in order."""

    def eval(self, text: str) -> Iterator[tuple]:
        for found in dict.fromkeys(re.findall(r"\b(\d{6,8})\b", text or "")):
            yield (found,)


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    for name, arguments, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("extract_strengths", ExtractStrengths)
    spark.udtf.register("extract_ids", ExtractIds)
