"""What a store's write statements do, as functions of immutable tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last write wins: of all rows of a key the one with the largest ``seq``."""
    both = base.unionByName(new)
    value = F.struct(*(c for c in both.columns if c not in keys))
    return both.groupBy(*keys).agg(F.max_by(value, seq).alias("_v")).select(*keys, *(F.col(f"_v.{c}").alias(c) for c in both.columns if c not in keys)).select(both.columns)


def insert_or_ignore(base: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First writer wins: rows of ``new`` whose key ``base`` has not, the first of each key, added."""
    fresh = new.join(base.select(keys).distinct(), keys, "left_anti")
    fresh = fresh.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
    return base.unionByName(fresh)


def fill_missing(base: DataFrame, new: DataFrame, key: str, blanks: list[str], overrides: list[str] = ()) -> DataFrame:
    """Columns ``blanks`` are filled only where empty; ``overrides`` are replaced wherever ``new`` has a value."""
    n = new.select(key, *(F.col(c).alias(f"_{c}") for c in (*blanks, *overrides)))
    out = base.join(n, key, "left")
    for c in blanks:
        out = out.withColumn(c, F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), f"_{c}", c))
    for c in overrides:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.select(base.columns)


def delete_cascade(gone: DataFrame, key: str, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """Every child table without the rows whose foreign key is among ``gone``."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    return [child.join(ids, F.col(fk) == F.col("_gone"), "left_anti") for child, fk in children]


def reassign(child: DataFrame, fk: str, old: int, new: int) -> DataFrame:
    return child.withColumn(fk, F.when(F.col(fk) == old, F.lit(new).cast(dict(child.dtypes)[fk])).otherwise(F.col(fk)))


def transfer_unique(child: DataFrame, fk: str, old: int, new: int, keys: list[str], seq: str) -> DataFrame:
    """:func:`reassign` for a child with a unique key: of rows that then collide the one with the largest ``seq`` stays."""
    moved = reassign(child, fk, old, new)
    return upsert(moved.limit(0), moved, keys, seq)


def orphans(files: DataFrame, digest: str, path: str, reports: DataFrame, report_hash: str, documents: DataFrame, document_path: str) -> DataFrame:
    """Files that no report was read from (its hash starts with theirs, up to a bar) and no document lies at."""
    used = reports.select(F.split_part(F.col(report_hash), F.lit("|"), F.lit(1)).alias("_d")).distinct()
    at = documents.select(F.col(document_path).alias("_p")).distinct()
    return files.join(used, F.col(digest) == F.col("_d"), "left_anti").join(at, F.col(path) == F.col("_p"), "left_anti")


def backfill(existing: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, one for each key of ``source`` that ``existing`` lacks, with the number of source rows; repeating it adds nothing."""
    return source.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(existing.select(keys).distinct(), keys, "left_anti")


def conform(df: DataFrame, schema) -> DataFrame:
    """Additive migration: columns of ``schema`` that are missing are added as null, all cast; other columns go."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def newest(*sources: tuple[DataFrame, str, str], name: str = "newest") -> DataFrame:
    """Largest timestamp of a person over several tables, each (table, person column, time column)."""
    parts = [df.groupBy(F.col(p).alias("person_id")).agg(F.max(t).alias(name)) for df, p, t in sources]
    return reduce(DataFrame.unionByName, parts).groupBy("person_id").agg(F.max(name).alias(name))


def is_stale(newest_data: Column, last_report: Column) -> Column:
    """Whether a stored report is missing or older than the data; a report without data is fresh."""
    return last_report.isNull() | F.coalesce(newest_data > last_report, F.lit(False))
