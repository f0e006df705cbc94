"""Spelling variants: words within one edit, found by an even-partition pigeonhole join, and the form that each stands for."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.llm.common import keep, materialise

#: Runs of letters that are words.
RUN = r"[A-Za-zÀ-ÿ]+"


def occurrences(docs: DataFrame, least_chars: int = 5) -> DataFrame:
    """doc_id and word: each maximal run ``[A-Za-z\\u00C0-\\u00FF]+`` of at least ``least_chars`` code points, A-Z lower-cased."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("word")).filter(F.length("word") >= least_chars)
    return runs.select("doc_id", F.translate("word", string.ascii_uppercase, string.ascii_lowercase).alias("word"))


def one_letter_lost(words: DataFrame, every: int = 97) -> DataFrame:
    """Occurrences where each whose hash crc32(``doc_id:word``) ``every`` divides has lost its code point hash % length (null doc_id: no text)."""
    hashed = words.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary")))
    at = (F.col("h") % F.length("word")).cast("int")
    less = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
    return hashed.select("doc_id", F.when(F.col("h") % every == 0, less).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, least: int = 3, least_chars: int = 5) -> DataFrame:
    """word and n: words of at least ``least_chars`` code points that occur ``least`` times or more."""
    counts = words.filter(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= least)


def _half(word: Column, size: Column) -> Column:
    """Length of the first of two even segments of a word of ``size`` code points; the second has the rest."""
    return F.floor(size / 2).cast("int")


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, n_a, b, n_b) of words (word, n; distinct words) that differ by one inserted, deleted or replaced code point, each once, a not longer than b.

    A word of l code points has two segments, its first floor(l / 2) and the rest; both are indexed with l.
    One edit spoils one of them at most, so a word of l or l + 1 code points that is near holds the
    other: the first at its start, the second at its end, one place further if the word is longer. So
    each word looks for words of its own length and one less, with two pieces each. A pair that meets at
    both is kept at the first segment alone; then the edit is verified. A pair of one length is
    kept where a < b.

    Words are distinct, so a key has few rows unless short words share half of their letters; both sides
    are tables that are read, so adaptive execution splits what is left of such keys. The test of a pair
    runs inside the join, which puts out near pairs alone.
    """
    size = F.length("word").cast("int")
    word = words.select("word", "n", size.alias("size"), _half(F.col("word"), size).alias("half"))
    first, rest = F.substr("word", F.lit(1), F.col("half")), F.substr("word", F.col("half") + 1)
    index = word.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.inline(F.array(*(F.struct(F.col("size").alias("l"), F.lit(k).alias("k"), piece.alias("piece")) for k, piece in ((0, first), (1, rest))))))
    probes = []
    for less in (0, 1):
        of = F.col("size") - less
        half = _half(F.col("word"), of)
        pieces = ((0, F.substr("word", F.lit(1), half)), (1, F.substr("word", half + 1 + less)))
        probes += [F.struct(of.alias("l"), F.lit(k).alias("k"), piece.alias("piece")) for k, piece in pieces]
    probe = word.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.inline(F.array(*probes)))
    half = F.floor(F.col("l") / 2).cast("int")
    shared_first = F.substr("a", F.lit(1), half) == F.substr("b", F.lit(1), half)
    met = index.join(probe, ["l", "k", "piece"]).filter((F.length("b") > F.length("a")) | (F.col("a") < F.col("b")))
    return met.filter((F.col("k") == 0) | ~shared_first).filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")


def spelling_groups(words: DataFrame, ratio: float = 2.0) -> DataFrame:
    """One row for each word (word, n; distinct words) with the form that it is a variant of.

    Returns word, form, root, n, n_near and form_n. n_near counts its near words (:func:`near_pairs`). The
    form is the near word of largest n, of equal ones the first in code point order, if that n is at
    least ``ratio`` times (more than once) the word's own; else null. The root follows forms to the last; a word
    without a form is its own root. A word without near words has n_near 0. An empty table gives no rows.

    As n grows ``ratio`` times with each step, paths are no longer than the logarithm of the largest
    n; each round of the search for roots doubles the steps it looks ahead.
    """
    if ratio <= 1:
        raise ValueError("a form has to occur more often than its variants")
    words = materialise(words.select("word", "n"), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))))
    best = F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best")
    near = keep(both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best))
    takes = -F.col("best.less") >= F.col("n") * ratio
    joined = words.join(near, "word", "left")
    forms = joined.select("word", "n", F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
    forms = materialise(forms, "forms", (near,))
    up = keep(forms.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialise(up.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots", (up,))
        up = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    return forms.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
