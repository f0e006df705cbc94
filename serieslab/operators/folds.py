"""Folds over the rows of a group in order, for groups of any size: ranges of rows are folded at once and then chained."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieslab.session import stored

#: Rows of a range, as powers of two: of numbers, and of signatures.
RANGE, SIGNATURES = 16, 12
#: Rounds in which ranges take over what the one before them keeps; groups that are open then are folded in one pass.
ROUNDS = 12


def _sorted(df: DataFrame, name: str, bits: int, *columns: Column, by: tuple[str, ...] = ("g", "o")) -> DataFrame:
    """Columns with ``pos`` and ``block``: rows numbered in the order of ``by``, sorted by range of g and o and written."""
    rows = df.select(*columns).repartitionByRange("g", "o").sortWithinPartitions(*by)
    return stored(rows.withColumn("pos", F.monotonically_increasing_id()), name).withColumn("block", F.shiftright("pos", bits))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one group and block at a time, from batches in which those lie together."""
    held, of = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = pc.dictionary_encode(batch.column("g"), null_encoding="encode").indices.to_numpy()
        block = batch.column("block").to_numpy()
        cuts = np.flatnonzero((group[1:] != group[:-1]) | (block[1:] != block[:-1])) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = (batch.column("g")[a].as_py(), int(block[a]))
            if held and key != of:
                yield pa.Table.from_batches(held)
                held = []
            of = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _each_run(df: DataFrame, of: Callable[[pa.Table], list[pa.Array]], schema: str) -> DataFrame:
    """``of`` for the rows of each group and block, in order."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for rows in _runs(batches):
            found = pa.RecordBatch.from_arrays(of(rows), names)
            waiting.append(found)
            n += found.num_rows
            if n >= 10_000:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, n = [], 0
        if n:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    return df.repartition("block").sortWithinPartitions("pos").mapInArrow(run, schema)


def _wide(rows: DataFrame) -> DataFrame:
    """Groups (w) that lie in several ranges; there are fewer than two a range."""
    return rows.groupBy(F.col("g").alias("w")).agg(F.min("block").alias("a"), F.max("block").alias("b")).filter("a < b").select("w", F.lit(True).alias("wide"))


def _joined(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows with what is known at the beginning of their range, null where nothing is."""
    e = entries.withColumnsRenamed({"g": "eg", "block": "eblock"})
    return rows.join(e, (F.col("block") == F.col("eblock")) & F.col("g").eqNullSafe(F.col("eg")), "left").drop("eg", "eblock")


def chunk_table(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a range: running sums at the rows where its first new chunk can begin, and for each the fill of the last chunk and the number of chunks then.

    Such a row has at most ``most`` before it in the range. From each row the next chunk begins where the
    sum first exceeds ``most``: a search in the running sums gives that row, and doubling the steps follows it to the end.
    """
    sums, n = np.cumsum(sizes), len(sizes)
    after = np.maximum(np.searchsorted(sums, sums - sizes + most, side="right"), np.arange(1, n + 1))
    at = np.where(after < n, after, np.arange(n))
    count = (after < n).astype(np.int64)
    while True:
        further = at[at]
        if (further == at).all():
            break
        count, at = count + count[at], further
    can = int(np.searchsorted(sums - sizes, most, side="right"))
    return sums[:can], (sums[-1] - sums[at] + sizes[at])[:can], count[:can] + 1


def greedy_chunks(df: DataFrame, group: str, order: str, size: str, most: int, bits: int = RANGE) -> DataFrame:
    """``chunk`` of each row, filled in order up to ``most``; a row that would overflow starts the next chunk.

    Returns group, order, size (long) and chunk. A row larger than ``most`` has a chunk of its own; a null or
    negative size counts as 0 and a null group is a group; rows with the same order come by size.

    A running sum can't do this, as it starts anew with each chunk. Rows are sorted by range and cut into
    ranges of 2**bits. Groups within one range are filled there. For each range of a larger
    group a table tells for every row with which its first chunk can begin how full the last chunk is then, and
    how many there are (:func:`chunk_table`); its rows are about those of one chunk. One pass over these
    tables, range by range, gives the fill and the number of the chunk at the beginning of each range,
    and all ranges are filled at once.
    """
    kinds = dict(df.dtypes)
    amount = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    rows = _sorted(df, "chunks", bits, F.col(group).alias("g"), F.col(order).alias("o"), F.col(size).cast("long").alias("given"), amount.alias("s"), by=("g", "o", "s"))

    def summary(run: pa.Table) -> list[pa.Array]:
        sizes = run.column("s").to_numpy()
        tables = [x.astype(np.int64).tobytes() for x in chunk_table(sizes, most)]
        return [run.column("g").slice(0, 1).combine_chunks(), pa.array([run.column("block")[0].as_py()], pa.int64()), pa.array([int(sizes.sum())]), *(pa.array([t], pa.binary()) for t in tables)]

    wide = rows.join(_wide(rows), F.col("g").eqNullSafe(F.col("w")), "left_semi")
    tables = _each_run(wide.select("g", "block", "pos", "s"), summary, f"g {kinds[group]}, block long, total long, sums binary, fills binary, counts binary")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, filled, chunk = object(), None, 0
        for batch in batches:
            entry = []
            for g, total, *packed in zip(*(batch.column(c).to_pylist() for c in ("g", "total", "sums", "fills", "counts")), strict=True):
                if g != of:
                    of, filled, chunk = g, None, 0
                entry.append((filled, chunk))
                sums, fills, counts = (np.frombuffer(b, np.int64) for b in packed)
                i = 0 if filled is None else int(np.searchsorted(sums, most - filled, side="right"))
                if i == len(sums):
                    filled += total
                else:
                    chunk += int(counts[i]) - (filled is None)
                    filled = int(fills[i])
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("block"), *(pa.array([e[j] for e in entry], pa.int64()) for j in (0, 1))], ["g", "block", "filled", "chunk"])

    entries = tables.repartition("g").sortWithinPartitions("g", "block").mapInArrow(chain, f"g {kinds[group]}, block long, filled long, chunk long")

    def fill(run: pa.Table) -> list[pa.Array]:
        filled, chunk, out = run.column("filled")[0].as_py(), run.column("chunk")[0].as_py() or 0, []
        for n in run.column("s").to_pylist():
            if filled is not None and filled + n > most:
                chunk, filled = chunk + 1, 0
            filled = (filled or 0) + n
            out.append(chunk)
        return [*(run.column(c).combine_chunks() for c in ("g", "o", "given")), pa.array(out, pa.int64())]

    done = _each_run(_joined(rows, stored(entries, "entries")), fill, f"g {kinds[group]}, o {kinds[order]}, given long, chunk long")
    return done.select(F.col("g").alias(group), F.col("o").alias(order), F.col("given").alias(size), "chunk")


def _like(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    return (np.abs(a - b).mean() if len(a) == len(b) else 1.0) < least


def keep_unlike_last(df: DataFrame, group: str, order: str, signature: str, least: float, bits: int = SIGNATURES, rounds: int = ROUNDS) -> DataFrame:
    """Rows (group, order) kept by a pass that drops a signature within ``least`` of the last *kept* one.

    A row without a signature is kept and resets the pass; signatures of unequal length are unlike.
    A null group is a group.

    Rows are sorted by range and cut into ranges of 2**bits, and each range is first passed as if nothing
    came before it. Then ranges of a larger group take over what the one before them kept last, all at once, and those
    where that changes what they keep last pass it on in the next round. A pass forgets where it began as
    soon as it keeps a row that it would have kept anyway, so this takes few rounds. Groups that still
    change after ``rounds``, such as a long still picture, are passed from beginning to end, row by row.
    """
    kinds = dict(df.dtypes)
    rows = _sorted(df, "signatures", bits, F.col(group).alias("g"), F.col(order).alias("o"), F.col(signature).cast("array<double>").alias("s"))
    schema = f"g {kinds[group]}, block long, kept array<{kinds[order]}>, entry long, leaves long, v array<double>"

    def step(run: pa.Table) -> list[pa.Array]:
        entry, last = run.column("entry")[0].as_py(), run.column("v")[0].as_py()
        last, leaves, kept = None if last is None else np.array(last), entry, []
        for i, (s, pos) in enumerate(zip(run.column("s"), run.column("pos").to_pylist(), strict=True)):
            s = np.asarray(s.values.to_numpy(zero_copy_only=False), float) if s.is_valid else None
            if last is not None and s is not None and _like(last, s, least):
                continue
            last, leaves = s, None if s is None else pos
            kept.append(i)
        orders = run.column("o").combine_chunks().take(pa.array(kept, pa.int32()))
        listed = pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), orders)
        return [run.column("g").slice(0, 1).combine_chunks(), pa.array([run.column("block")[0].as_py()]), listed, pa.array([entry], pa.int64()), pa.array([leaves], pa.int64()), pa.array([None if last is None else last.tolist()], pa.list_(pa.float64()))]

    fresh = rows.withColumn("entry", F.lit(None).cast("long")).withColumn("v", F.lit(None).cast("array<double>"))
    state = stored(_each_run(fresh, step, schema), "passes")
    before = Window.partitionBy("g").orderBy("block")
    finished = None
    for done in range(rounds + 1):
        todo = state.select("g", "block", "entry", F.lag("leaves").over(before).alias("enters"), F.lag("v").over(before).alias("v")).filter("not (enters <=> entry)")
        todo = stored(todo.select("g", "block", F.col("enters").alias("entry"), "v", F.lit(True).alias("todo")), "entries")
        if todo.isEmpty():
            break
        if done == rounds:
            open_ = todo.select(F.col("g").alias("w")).distinct()
            finished = _whole(rows.join(open_, F.col("g").eqNullSafe(F.col("w")), "left_semi"), least, kinds[group], kinds[order])
            state = state.join(open_, F.col("g").eqNullSafe(F.col("w")), "left_anti")
            break
        again = _each_run(_joined(rows, todo).filter("todo").drop("todo"), step, schema)
        keys = todo.select(F.col("g").alias("w"), F.col("block").alias("b"))
        same = state.join(keys, (F.col("block") == F.col("b")) & F.col("g").eqNullSafe(F.col("w")), "left_anti")
        state = stored(same.unionByName(again), "passes")
    out = state.select("g", F.explode("kept").alias("o"))
    out = out if finished is None else out.unionByName(finished)
    return out.select(F.col("g").alias(group), F.col("o").alias(order))


def _whole(rows: DataFrame, least: float, group: str, order: str) -> DataFrame:
    """The pass over whole groups: sorted rows as a stream, one signature in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last = object(), None
        for batch in batches:
            kept = []
            for i, (g, s) in enumerate(zip(batch.column("g").to_pylist(), batch.column("s"), strict=True)):
                if g != of:
                    of, last = g, None
                s = np.asarray(s.values.to_numpy(zero_copy_only=False), float) if s.is_valid else None
                if last is not None and s is not None and _like(last, s, least):
                    continue
                last = s
                kept.append(i)
            yield batch.select(["g", "o"]).take(pa.array(kept, pa.int32()))

    return rows.repartition("g").sortWithinPartitions("pos").select("g", "o", "s").mapInArrow(run, f"g {group}, o {order}")
