"""Rules over one value and its reference range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(v: Column, low: Column, high: Column) -> Column:
    """L, H or N; empty without a value or without limits."""
    return F.when(v.isNull() | (low.isNull() & high.isNull()), "").when(v < low, "L").when(v > high, "H").otherwise("N")


def severity(v: Column, low: Column, high: Column, critical_high: Column, critical_low: Column) -> Column:
    """red or yellow for a value and limits, null without them.

    Beyond a critical limit: red. With both limits the distance outside is measured in spans (the
    range, but at least 0.3 of either limit's size): over 0.6 is red. With one limit half as much again,
    or less than half of it, is red. All else is yellow, also inside the range, where the status counts.
    """
    span = F.greatest(high - low, 0.3 * F.abs(low), 0.3 * F.abs(high), F.lit(1e-9))
    both = low.isNotNull() & high.isNotNull()
    far = F.when(both, ((v > high) & ((v - high) / span > 0.6)) | ((v < low) & ((low - v) / span > 0.6))).otherwise(((v > high) & (v > 1.5 * high)) | ((v < low) & (v < 0.5 * low)))
    critical = F.coalesce(v > critical_high, F.lit(False)) | F.coalesce(v < critical_low, F.lit(False))
    return F.when(v.isNull() | (low.isNull() & high.isNull()), F.lit(None).cast("string")).when(critical | F.coalesce(far, F.lit(False)), "red").otherwise("yellow")


def numeric_status(v: Column, low: Column, high: Column) -> Column:
    """bajo, alto or normal; ``no_realizado`` without a value."""
    return F.when(v.isNull(), "no_realizado").when(v < low, "bajo").when(v > high, "alto").otherwise("normal")


# Qualitative results that are normal, those that are positive, and keys for which positive is grave.
NEGATIVE = ("negativo", "no detectable", "trazas", "neg", "ausente")
POSITIVE = ("positivo", "pos", "detectable")
GRAVE_IF_POSITIVE = ("influenza_a", "influenza_b", "rsv", "adenovirus", "mycoplasma")


def qualitative_status(qual: Column) -> Column:
    """normal, positivo or no_realizado of a normalised qualitative result."""
    return F.when(qual.isin(*NEGATIVE), "normal").when(qual.isin(*POSITIVE), "positivo").otherwise("no_realizado")


def qualitative_severity(qual: Column, key: Column) -> Column:
    return F.when(qual.isin(*POSITIVE), F.when(key.isin(*GRAVE_IF_POSITIVE), "red").otherwise("yellow"))


def trend(v: Column, previous: Column) -> Column:
    """estable, subiendo or bajando against the previous row's value; empty if either is missing."""
    return F.when(v.isNull() | previous.isNull(), "").when(F.abs(v - previous) < 1e-9, "estable").when(v > previous, "subiendo").otherwise("bajando")


def severity_rank(s: Column, none: int = 3) -> Column:
    return F.when(s == "red", 0).when(s == "yellow", 1).when(s == "green", 2).otherwise(none)
