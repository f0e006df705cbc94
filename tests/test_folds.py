"""Folds over groups that lie in many ranges, against one pass row by row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from serieslab.operators import folds


def chunks(rows, most):
    out, state = {}, {}
    for g, o, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], max(r[2] or 0, 0))):
        n = max(n or 0, 0)
        filled, chunk = state.get(g, (None, 0))
        if filled is not None and filled + n > most:
            filled, chunk = 0, chunk + 1
        state[g] = ((filled or 0) + n, chunk)
        out[g, o] = chunk
    return out


@pytest.mark.parametrize("bits", [1, 3, 16])
@pytest.mark.parametrize("most, top", [(50, 20), (7, 20), (1000, 9), (10**9, 5), (0, 2)])
def test_greedy_chunks(spark, bits, most, top):
    rng = random.Random(most)
    rows = [(g, i, rng.choice([rng.randint(0, top), 0, None, -3, rng.randint(0, top)])) for g, n in (("a", 300), ("b", 3), (None, 40), ("c", 1), ("d", 60)) for i in range(n)]
    frame = spark.createDataFrame(rows, "g string, i int, n int").repartition(3).withColumnsRenamed({"g": "pos", "i": "block", "n": "chunks"})
    got = folds.greedy_chunks(frame, "pos", "block", "chunks", most, bits=bits)
    assert got.columns == ["pos", "block", "chunks", "chunk"]
    assert {(r.pos, r.block): r.chunk for r in got.collect()} == chunks(rows, most)
    assert {(r.pos, r.block): r.chunks for r in got.collect()} == {(g, i): n for g, i, n in rows}
    assert folds.greedy_chunks(frame.limit(0), "pos", "block", "chunks", most).count() == 0


def test_a_key_of_a_million_rows(spark):
    """One key in many ranges and tasks; the table of a range has the rows of about one chunk."""
    frame = spark.range(1_000_000).select(F.lit("k").alias("g"), F.col("id").alias("o"), (F.pmod(F.xxhash64("id"), F.lit(97))).alias("n"))
    got = folds.greedy_chunks(frame, "g", "o", "n", 5000, bits=14)
    sizes = np.array([r.n for r in frame.orderBy("o").select("n").collect()])
    want, filled, chunk = [], None, 0
    for n in sizes.tolist():
        if filled is not None and filled + n > 5000:
            filled, chunk = 0, chunk + 1
        filled = (filled or 0) + n
        want.append(chunk)
    assert [r.chunk for r in got.orderBy("o").select("chunk").collect()] == want
    assert got.select(F.spark_partition_id().alias("p")).groupBy("p").count().count() > 1
    sums, _, _ = folds.chunk_table(sizes[: 1 << 14], 5000)
    assert len(sums) < 250


def unlike(rows, least):
    out, state = set(), {}
    for g, o, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        last = state.get(g)
        if last is not None and s is not None and (np.abs(np.array(last) - np.array(s)).mean() if len(last) == len(s) else 1.0) < least:
            continue
        state[g] = s
        out.add((g, o))
    return out


@pytest.mark.parametrize("bits, rounds", [(1, 12), (3, 12), (3, 1), (1, 0), (12, 12)])
def test_keep_unlike_last(spark, bits, rounds):
    rng = random.Random(bits)
    rows = []
    for g, n in (("a", 120), ("still", 60), (None, 30), ("b", 2)):
        x = 0.0
        for i in range(n):
            x += 0 if g == "still" else rng.choice([0.0, 0.02, 0.05, 0.3, -0.1])
            rows.append((g, i, None if g != "still" and rng.random() < 0.04 else [x, x] if rng.random() < 0.97 else [x]))
    frame = spark.createDataFrame(rows, "g string, i int, s array<float>").repartition(3)
    got = folds.keep_unlike_last(frame, "g", "i", "s", 0.1, bits=bits, rounds=rounds).collect()
    exact = [(g, i, None if s is None else [float(np.float32(x)) for x in s]) for g, i, s in rows]
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == unlike(exact, 0.1)
