"""Exact duplicates by distributed most-significant-digit radix partitioning."""

from __future__ import annotations

import string
from functools import reduce

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.llm import bloom
from serieslab.llm.common import keep, materialise, numbered

#: Bytes of the first digit, and by how much each digit is wider than the one before.
FIRST_DIGIT, WIDER = 64, 4


def _may_repeat(sent: Broadcast, bits: int) -> Column:
    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        return pd.Series(bloom.contains(sent.value, bits, h.to_numpy().view("uint64")))

    return may("h")


def exact_dedup(docs: DataFrame, digest: bool = True, max_bits: int = 1 << 28) -> DataFrame:
    """One row for each row of ``docs`` with the class of texts equal but for the case of A-Z.

    Returns row (number of the input row), doc_id, keep_id, group_size, kept and text_sha256 (of the
    lower-cased text, as a by-product: it decides nothing). Of equal texts the row with the largest
    doc_id stays; of rows with that doc_id the last one in scan order, so exactly one row of a group
    has ``kept``. A null text counts as empty, a null doc_id as smaller than any other. Other columns
    of ``docs``, whatever their names, are not read. An empty table gives no rows.

    Round k looks at one digit, the next 64 * 4**k bytes of each text that is still open, and at how
    many bytes are left: rows of a group that share both form the next group. A group of one row, or one
    whose text ends within the digit, is done and leaves. Groups are counted over the digits alone, with
    partial sums before the shuffle; a Bloom filter over the groups of two or more (at most ``max_bits``
    bits; past that it lets more rows through) then shows which rows have no partner, and these leave
    before any text moves. Only the others are joined with their group: one row a group, so adaptive
    execution splits a very large one. The number of rounds follows the logarithm of the longest
    repeated text.
    """
    spark = docs.sparkSession
    text = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase).cast("binary")
    cur = numbered(docs, "row", ["doc_id", "text"]).select("row", "doc_id", F.lit(0).cast("long").alias("gid"), text.alias("rest"))
    cur = cur.select("row", "doc_id", "gid", (F.sha2("rest", 256) if digest else F.lit(None).cast("string")).alias("text_sha256"), "rest")
    done, width, k = [], FIRST_DIGIT, 0
    own = ["gid", "left", "digit"]
    while True:
        digits = cur.withColumn("left", F.length("rest")).withColumn("digit", F.substring("rest", 1, width))
        groups = digits.groupBy(own).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "row")).alias("keep"), F.min("row").alias("next_gid"))
        groups = keep(groups.filter("n > 1"))
        bits = bloom.bits_for(groups.count(), max_bits)
        sent = spark.sparkContext.broadcast(bloom.build(groups.select(F.xxhash64(*own)), lambda b: b.column(0).to_numpy().view("uint64"), bits, "once"))
        flagged = digits.withColumn("h", F.xxhash64(*own)).withColumn("may", _may_repeat(sent, bits))
        alone = flagged.filter("not may").select("row", "doc_id", "gid", "text_sha256", F.lit(1).cast("long").alias("n"), F.struct("doc_id", "row").alias("keep"), F.lit(False).alias("open"), F.lit(None).cast("binary").alias("rest"))
        open_ = F.col("n").isNotNull() & (F.col("left") > width)
        split = flagged.filter("may").drop("h", "may").join(groups, own, "left").select(
            "row", "doc_id", F.coalesce("next_gid", "gid").alias("gid"), "text_sha256", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("keep", F.struct("doc_id", "row")).alias("keep"),
            open_.alias("open"), F.when(open_, F.substring("rest", width + 1, 2**31 - 1)).alias("rest"),
        )
        table = materialise(alone.unionByName(split), f"radix-{k}", (groups,))
        done.append(table.filter("not open").drop("rest"))
        cur = table.filter("open").select("row", "doc_id", "gid", "text_sha256", "rest")
        if cur.isEmpty():
            break
        width, k = width * WIDER, k + 1
    return reduce(DataFrame.unionByName, done).select(
        "row", "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256"
    )
