"""Benchmark decontamination by winnowing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslab.llm import bloom
from serieslab.llm.common import arrow_map, row_id, splitmix
from serieslab.llm.words import LETTERS_DIGITS, Words, lowered, together

TOP = np.uint64(2**64 - 1)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each position on (len - k + 1 of them)."""
    out = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        out = out * np.uint64(0x100000001B3) + words[j : j + len(out)]
    return splitmix(out)


def window_fingerprints(hashes: np.ndarray, owner: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``span`` consecutive words of one text: its position and its minimum k-gram hash.

    This is winnowing with span - k + 1 k-grams a window: two texts that share ``span`` words share
    the k-grams of that window, so they select the same minimum there.
    """
    grams = gram_hashes(hashes, k)
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = grams[:n].copy()
    for j in range(1, span - k + 1):
        np.minimum(least, grams[j : j + n], out=least)
    at = np.flatnonzero(owner[:n] == owner[span - 1 :])
    return at, least[at]


def _windows(words: Words, span: int, k: int, short: list[int], owner: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, fingerprints) of the windows of ``span`` words and of each short length."""
    hashes = words.hashes()
    return [(n, *window_fingerprints(hashes, owner, n, min(k, n))) for n in (span, *short)]


def _owners(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.counts)), words.counts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5, max_bits: int = 1 << 28, row: str | None = None) -> DataFrame:
    """Words of each document inside a passage that it shares with an item of ``benchmark``.

    A-Z are lower-cased; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is ``span``
    consecutive words of an item; an item with fewer, but not none, is one window. A word of a document
    inside any occurrence of a window is hit. Returns one row for each row of ``docs``, repeated doc_ids
    included: row, doc_id, n_words, n_hit, spans (array of start and length of the windows found, in
    words), items (ids of items with a window there). A null text has no words; an empty benchmark
    hits nothing; item rows that repeat count once. ``row`` names a column with a number of each row;
    without it rows are numbered here. Other columns are not read.

    Both sides give each window its winnowing fingerprint, the minimum k-gram hash in it. A Bloom
    filter over the benchmark's fingerprints (at most ``max_bits`` bits, so at most 32 MB at the
    default) is sent to the tasks that scan the documents; only windows that pass it leave a task, and
    those are joined with the benchmark's distinct windows by fingerprint and words, which extends the
    match of k words to the whole window and makes it exact. That join has one row a distinct window
    on the benchmark's side, so a passage that many documents and items share makes no pairs of rows.
    A larger benchmark than the filter was made for only lets more windows through.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))

    def item_windows(short: list[int]) -> callable:
        def make() -> callable:
            def of(batch: pa.RecordBatch) -> pa.RecordBatch:
                ids, rows = batch.column(0).to_pylist(), []
                for first, part in together(lowered(batch.column(1))):
                    words = Words(part, LETTERS_DIGITS)
                    owner = _owners(words)
                    for n, at, prints in _windows(words, span, k, short, owner):
                        for i, fp in zip(at.tolist(), prints.view(np.int64).tolist(), strict=True):
                            if n == span or words.counts[owner[i]] == n:
                                rows.append((ids[first + owner[i]], n, fp, words.text(i, i + n)))
                return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.string()))], ["item_id", "len", "fp", "win"])

            return of

        return make

    def lengths() -> callable:
        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = np.concatenate([Words(part, LETTERS_DIGITS).counts for _, part in together(lowered(batch.column(1)))])
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(counts, span).astype(np.int32))], ["len"])

        return of

    found = {r[0]: r[1] for r in arrow_map(items, lengths, "len int").groupBy("len").count().collect()}  # at most span + 1 rows
    short = sorted(n for n in found if 0 < n < span)
    windows = arrow_map(items, item_windows(short), "item_id string, len int, fp long, win string")
    windows = windows.groupBy("fp", "len", "win").agg(F.collect_set("item_id").alias("items"))
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = bloom.bits_for(size // 4, max_bits)
    table = spark.sparkContext.broadcast(bloom.build(windows.select("fp"), lambda b: b.column(0).to_numpy().view(np.uint64), bits, "once"))

    def scan() -> callable:
        prints_of = table.value

        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows_in, ids = batch.column(0).to_numpy(), batch.column(1)
            counts, hits = [], []
            for first, part in together(lowered(batch.column(2))):
                words = Words(part, LETTERS_DIGITS)
                owner = _owners(words)
                counts.append(words.counts)
                for n, at, prints in _windows(words, span, k, short, owner):
                    if not len(at):
                        continue
                    heads = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))  # neighbours often share their minimum
                    passed = np.repeat(bloom.contains(prints_of, bits, prints[heads]), np.diff(np.append(heads, len(prints))))
                    for i in np.flatnonzero(passed):
                        w = int(at[i])
                        hits.append((first + owner[w], w - words.first[owner[w]], n, prints[i].view(np.int64), words.text(w, w + n)))
            n_docs = len(rows_in)
            own = np.concatenate([np.arange(n_docs), np.array([h[0] for h in hits], np.int64)])
            pad = [None] * n_docs
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(rows_in[own]), ids.take(pa.array(own)), pa.array(np.concatenate(counts)[own].astype(np.int64)),
                    pa.array(pad + [int(h[1]) for h in hits], pa.int64()), pa.array(pad + [h[2] for h in hits], pa.int32()),
                    pa.array(rows_in.tolist() + [int(h[3]) for h in hits], pa.int64()), pa.array(pad + [h[4] for h in hits], pa.string()),
                ],
                ["row", "doc_id", "n_words", "start", "len", "fp", "win"],
            )

        return of

    # each document also gives a row without a window; its fp, the row number, spreads these over the join
    scanned = arrow_map(docs.select(row_id(row).alias("row"), "doc_id", "text"), scan, "row long, doc_id long, n_words long, start long, len int, fp long, win string")
    hits = scanned.join(windows, ["fp", "len", "win"], "left")
    spans = F.collect_set(F.when(F.col("items").isNotNull(), F.struct("start", "len")))
    out = hits.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(spans).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))))
    return out.withColumn("n_hit", covered.cast("long"))
