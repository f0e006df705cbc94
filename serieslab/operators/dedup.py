"""Exact and near duplicates of files, reports and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieslab.operators.folds import greedy_chunks, keep_unlike_last  # noqa: F401
from serieslab.session import stored


def file_status(files: DataFrame, known: DataFrame) -> DataFrame:
    """``status`` of scanned files (path, sha1) against a registry: unchanged, duplicate or new.

    Of new files with equal content the first path is new, the others are its duplicates; an empty
    hash never matches.
    """
    same = known.select("path", F.col("sha1").alias("_known"))
    has = F.coalesce(F.col("sha1"), F.lit("")) != ""
    hashed = files.filter(has)  # those without a hash have nothing to be compared by, so they don't meet in one task
    # tables before the join by their key, so that adaptive execution splits a very common content
    content = stored(known.filter(has).select("sha1").distinct().withColumn("_seen", F.lit(True)), "known")
    first = stored(hashed.groupBy("sha1").agg(F.min("path").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"), "first")
    out = hashed.join(same, "path", "left").join(content, "sha1", "left").join(first, "sha1", "left")
    again = F.coalesce("_seen", F.lit(False)) | F.coalesce(F.col("path") != F.col("_first"), F.lit(False))
    status = F.when(F.col("_known") == F.col("sha1"), "unchanged").when(again, "duplicate").otherwise("new")
    out = out.withColumn("status", status).drop("_known", "_seen", "_first")
    return out.unionByName(files.filter(~has).withColumn("status", F.lit("new")))


def content_groups(df: DataFrame, content: str, order: str) -> DataFrame:
    """``copies`` and ``keep``: the number of rows with the same content and the first of them by ``order``; nulls are one content.

    Groups are counted by digest, with partial counts. Those of two rows or more are a table before
    the join, so adaptive execution splits a very common content and no task has all of it.
    """
    digests = df.withColumn("sha1", F.sha1(content))
    groups = digests.groupBy(F.col("sha1").alias("_sha1")).agg(F.count(F.lit(1)).alias("_copies"), F.min(order).alias("_keep"))
    groups = stored(groups.filter("_copies > 1"), "groups")
    out = digests.join(groups, F.col("sha1").eqNullSafe(F.col("_sha1")), "left")
    return out.withColumn("copies", F.coalesce("_copies", F.lit(1))).withColumn("keep", F.coalesce("_keep", order)).drop("_sha1", "_copies", "_keep")


def _first_of(df: DataFrame, keys: list, order: str) -> DataFrame:
    """The row of least ``order`` for each of the keys (columns or expressions); partial minima before the shuffle."""
    whole = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(*keys).agg(F.min_by(whole, order).alias("_row")).select("_row.*")


def new_reports(incoming: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Reports (key, person_id, date, lab, seq) to store: not by key, then not by person, date and laboratory.

    Plain equality throughout: an undated report never equals another. ``force`` skips the second test.
    The first of several in one batch stays.
    """
    out = _first_of(incoming.join(stored.select("key").distinct(), "key", "left_anti"), ["key"], "seq")
    if force:
        return out
    triple = ["person_id", "date", "lab"]
    out = out.join(stored.select(triple).distinct(), triple, "left_anti")
    # an undated one stays whatever others there are, so it has its key for a date
    place = F.coalesce(F.col("date").cast("string"), F.col("key")).alias("_place")
    return _first_of(out, ["person_id", place, "lab"], "seq")


def new_attachments(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Files (person_id, sha1, seq) that their person doesn't have yet: by digest, the first of several in one batch."""
    keys = ["person_id", "sha1"]
    rest = [c for c in incoming.columns if c not in keys]
    fresh = incoming.join(stored.select(keys).distinct(), keys, "left_anti")
    first = fresh.groupBy(keys).agg(F.min_by(F.struct(rest), "seq").alias("_r"))
    return first.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(incoming.columns)


def pairs_below(df: DataFrame, group: str, key: str, signature: str, most: float) -> DataFrame:
    """Pairs of a group whose signatures differ by at most ``most`` on average, earlier key first; groups are studies, small by nature."""
    a, b = (df.select(group, F.col(key).alias(x), F.col(signature).alias(f"_{x}")) for x in "ab")
    pairs = a.join(b, group).filter(F.col("a") < F.col("b")).withColumn("diff", signature_diff(F.col("_a"), F.col("_b")))
    return pairs.filter(F.col("diff") <= most).select(group, "a", "b", "diff")


def signature_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference of two signatures; 1 for unequal lengths."""
    diff = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.when(F.size(a) == F.size(b), diff).otherwise(1.0)


def block_mean(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """Means of runs of ``width`` places of a vector."""
    cells = df.select(key, F.posexplode(vector).alias("pos", "x"))
    return cells.groupBy(key, F.expr(f"pos div {width}").alias("block")).agg(F.avg(F.col("x").cast("double")).alias("mean"))


def percentiles(df: DataFrame, group: str, value: str, shares: list[float], bins: int = 4096) -> DataFrame:
    """Exact percentiles of each group, with linear interpolation, as the array ``percentiles``.

    A histogram of ``bins`` between the least and the largest value finds the bins that the wanted
    ranks fall into; only the distinct values of those are sorted. So no task holds a group's values.
    """
    rows = df.select(group, F.col(value).cast("double").alias("_x")).filter("_x is not null")
    limits = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    binned = rows.join(limits, group).withColumn("_bin", place.cast("long"))
    upto = Window.partitionBy(group).orderBy("_bin")
    counts = binned.groupBy(group, "_bin", "_n").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.sum("_c").over(upto) - F.col("_c"))
    rank = F.col("_share") * (F.col("_n") - 1)
    wanted = limits.select(group, "_n", F.posexplode(F.array(*map(F.lit, shares))).alias("_i", "_share")).withColumn("_f", rank - F.floor(rank))
    wanted = wanted.select(group, "_i", "_f", F.posexplode(F.array(F.floor(rank), F.ceil(rank))).alias("_end", "_rank"))
    inside = wanted.join(counts.drop("_n"), group).filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
    values = binned.join(inside.select(group, "_bin").distinct(), [group, "_bin"], "left_semi").groupBy(group, "_bin", "_x").agg(F.count(F.lit(1)).alias("_m"))
    values = values.withColumn("_low", F.sum("_m").over(Window.partitionBy(group, "_bin").orderBy("_x")) - F.col("_m"))
    at = F.col("_rank") - F.col("_before")
    ends = inside.join(values, [group, "_bin"]).filter((at >= F.col("_low")) & (at < F.col("_low") + F.col("_m")))
    ends = ends.groupBy(group, "_i", "_f").agg(F.min(F.when(F.col("_end") == 0, F.col("_x"))).alias("_a"), F.min(F.when(F.col("_end") == 1, F.col("_x"))).alias("_b"))
    found = F.array_sort(F.collect_list(F.struct("_i", (F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))).alias("x"))))
    return ends.groupBy(group).agg(F.transform(found, lambda s: s["x"]).alias("percentiles"))


def percentile_scale(df: DataFrame, group: str, value: str, low: float = 0.005, high: float = 0.995, top: float = 255.0) -> DataFrame:
    """``scaled``: values clipped to two percentiles of their group and mapped to 0 .. ``top``."""
    lo, hi = F.col("percentiles")[0], F.col("percentiles")[1]
    clipped = F.least(F.greatest(F.col(value), lo), hi)
    out = df.join(percentiles(df, group, value, [low, high]), group)
    return out.withColumn("scaled", F.when(hi > lo, (clipped - lo) / (hi - lo) * top).otherwise(0.0)).drop("percentiles")


def window_scale(pixel: Column, slope: Column, intercept: Column, centre: Column, width: Column, inverted: Column, top: float = 255.0) -> Column:
    """A stored pixel as a grey level: rescaled, mapped from centre +- width / 2 to 0 .. ``top``, turned round if ``inverted``."""
    value = pixel * F.coalesce(slope, F.lit(1.0)) + F.coalesce(intercept, F.lit(0.0))
    grey = F.greatest(F.lit(0.0), F.least(F.lit(top), (value - (centre - width / 2)) / F.greatest(width, F.lit(1.0)) * top))
    return F.when(inverted, F.lit(top) - grey).otherwise(grey)
