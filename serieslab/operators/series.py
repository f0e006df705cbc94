"""Operators over ordered series: latest and previous rows, blocks, picks, months."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieslab.functions.clinical import trend
from serieslab.functions.dates import month_key
from serieslab.session import stored


def latest(df: DataFrame, keys: list[str], at: Column, tie: Column, value: str = "value") -> DataFrame:
    """The last row of each series, with ``previous`` (the value of the row before), ``n`` and ``trend``.

    Rows without a date come first; of equal dates the larger ``tie`` is later. A null value in the row
    before leaves no trend: it is not skipped.

    Only the last two rows of a series matter, and the rank filter lets every task keep no more than
    those before the shuffle; the numbers of rows are summed apart, also with partial sums, and joined:
    one row a series on either side, null keys included.
    """
    ends = Window.partitionBy(*keys).orderBy(at.desc_nulls_last(), tie.desc())
    two = df.withColumn("_r", F.row_number().over(ends)).filter("_r <= 2")
    out = two.withColumn("previous", F.lead(value).over(ends)).filter("_r = 1").drop("_r")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    out = out.join(sizes.select(*(F.col(k).alias(f"_{k}") for k in keys), "n"), same).drop(*(f"_{k}" for k in keys))
    return out.withColumn("trend", trend(F.col(value), F.col("previous")))


def first_wins(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def first_middle_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """At most three representative rows of each group; a group of two gives both once."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("pos", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(w))
    return out.filter((F.col("pos") == 1) | (F.col("pos") == F.col("n")) | (F.col("pos") == F.expr("n div 2 + 1")))


def top_per_group(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("pos") <= k)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page ``number`` (from 0) of an ordered result: a bounded top-k, not a sort of everything into one task."""
    return df.orderBy(*order).limit((number + 1) * size).offset(number * size)


def monthly_last(df: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    """The last value of each key in each month."""
    last = F.max_by(F.struct(F.col(value).alias("value"), F.col(at).alias("at")), F.struct(at, tie))
    return df.groupBy(key, month_key(F.col(at)).alias("month")).agg(last.alias("last")).select(key, "month", F.col("last.value").alias("value"), F.col("last.at").alias("at"))


def monthly_pivot(monthly: DataFrame, key: str, months: list[str]) -> DataFrame:
    """One column for each of the given months; naming them spares a pass that would look for them.

    What a group holds are the months that it has, not a place for each of the given ones, and rows meet by key alone.
    """
    own = F.map_from_entries(F.collect_list(F.when(F.col("month").isNotNull(), F.struct("month", "value"))))
    listed = monthly.groupBy(key).agg(own.alias("_own"))
    return listed.select(key, *(F.col("_own")[m].alias(m) for m in months))


def blocks(lines: DataFrame, doc: str, order: list[str], is_header: Column) -> DataFrame:
    """``block``: number of headers up to and with the line, so a header starts a block; 0 before the first."""
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("block", F.sum(F.when(is_header, 1).otherwise(0)).over(w))


def carry_forward(lines: DataFrame, doc: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``name``: the last non-null ``value`` up to and with the line."""
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(w))


def next_line(doc: str, order: list[str], c: Column) -> Column:
    return F.lead(c).over(Window.partitionBy(doc).orderBy(*order))


def previous_line(doc: str, order: list[str], c: Column) -> Column:
    return F.lag(c).over(Window.partitionBy(doc).orderBy(*order))


def locale_order(c: Column) -> Column:
    """A text to sort by as readers of its language do: case and accents only break ties."""
    return F.collate(c, "UNICODE_CI_AI")


def row_numbers(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Consecutive numbers from 1 in the order of ``order``: sorted by range, so no task sorts all rows.

    The sorted rows are written, as they are read twice: for the size of each range, of which there is one
    row a partition, and for the numbers.
    """
    kept = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    sizes = sorted((r["_part"], r["n"]) for r in kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return kept.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_id") - F.shiftleft("_part", 33) + 1).drop("_id", "_part", "_before")
