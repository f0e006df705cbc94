"""Repair of conversations: the cheapest edits after which their turns follow the grammar of roles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.llm.common import keep, materialise

BLANK, ENDS = " \t\n\x0b\x0c\r", ".!?"
# Cost of a new role, of a deletion, of an insertion, and of a truncated turn that stays.
REROLE, DELETE, INSERT, LATE = 3, 4, 3, 3
#: Initials of roles, and states of the grammar (s?(ua)+)?: nothing yet, after a system, a user, an assistant turn.
INITIALS, START = " sua", 0
#: Where a kept initial leads from a state, and where a turn with the role of one's choice does: there is one that fits.
KEPT, CHOSEN = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (3, 2): 2, (2, 3): 3}, (2, 2, 3, 2)
LEGAL = {(1, 2), (2, 3), (3, 2)}
#: What is inserted after the last turn in each state, and its cost.
CLOSING = ("", "IuIa", "Ia", "")
CLOSED = tuple(INSERT * len(c) // 2 for c in CLOSING)
#: Rows of a segment; rows among which segments are cut; cells of a table of layers; no way.
SEGMENT, BLOCK, CELLS, NEVER = 16, 13, 4_000_000, 1 << 40
#: Bits of a row's code: initial in the lowest two, then blank, duplicate, truncated.
IS_BLANK, IS_COPY, IS_LATE = 4, 8, 16


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows after the damage that crc32(``conv_id:turn``) % 20 names; nulls are one space there.

    0 drops a row, 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats it, 4 makes its role user.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    code = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(shown[3], ENDS, "")).otherwise(shown[3])
    rows = conversations.select("conv_id", "turn", F.when(code == 4, "user").otherwise(shown[2]).alias("role"), text.alias("text"), code.alias("code"))
    times = F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter("code <> 0").select("conv_id", "turn", "role", "text", F.explode(times).alias("time")).drop("time")


def _layers(code: np.ndarray, seeds: np.ndarray, top: int) -> np.ndarray:
    """Cost layers of segments: bits of the states from which the end is reached at each exact cost, before each row.

    code: rows x segments, -1 where a segment has ended; seeds: cost x segments, the bits at the end.
    Four bits a word, so a word of 16 holds four ends at once. Layer c before row i joins what the
    rows after it have in lower layers, or, for a row that is kept, in the same one.
    """
    n, m = code.shape
    out = np.zeros((top + 1, n + 1, m), np.uint16)
    out[: len(seeds), n] = seeds
    ones = lambda x: np.where(x, np.uint16(0xFFFF), np.uint16(0))
    stays = (code >= 0) & (code & (IS_BLANK | IS_COPY) == 0)
    live, stay, late = ones(code >= 0), ones(stays), ones(code & IS_LATE > 0)
    own = [None, *(ones(stays & (code & 3 == k)) for k in (1, 2, 3))]
    nibble, none = np.uint16(0x1111), np.zeros(m, np.uint16)

    def before(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States from which a user and an assistant turn lead to ``bits``."""
        u, a = (bits >> 2) & nibble, (bits >> 3) & nibble
        return u | u << 1 | u << 3, a << 2

    for c in range(top + 1):
        back = lambda k, i, c=c: out[c - k, i] if c >= k else none
        for i in range(n - 1, -1, -1):
            same = np.where(late[i] > 0, back(LATE, i + 1), back(0, i + 1))
            u, a = before(same)
            bits = own[1][i] & ((same >> 1) & nibble) | own[2][i] & u | own[3][i] & a
            u, a = before(np.where(late[i] > 0, back(LATE + REROLE, i + 1), back(REROLE, i + 1)))
            bits |= stay[i] & (u | a)
            u, a = before(back(INSERT, i))
            bits |= back(DELETE, i + 1) | u | a
            out[c, i] = live[i] & bits | ~live[i] & back(0, i + 1)
    return out


def _tables(codes: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Segments of about the same length, by number, and their codes as rows x segments."""
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    room = -(-sizes // 4) * 4
    for n in np.unique(room).tolist():
        at = np.flatnonzero(room == n).tolist()
        most = max(1, CELLS // ((DELETE * n + 16) * (n + 1)))
        for i in range(0, len(at), most):
            part = at[i : i + most]
            yield part, np.array([[*codes[j], *[-1] * (n - len(codes[j]))] for j in part], np.int16).T


def crossing_costs(codes: list[bytes]) -> np.ndarray:
    """Least cost of each segment from each state before it (second axis) to each state after it (third): the first layers that have it."""
    out = np.full((len(codes), 4, 4), NEVER, np.int64)
    for part, code in _tables(codes):
        top = DELETE * len(code) + 2 * INSERT
        seeds = np.full((1, len(part)), sum(1 << (5 * e) for e in range(4)), np.uint16)
        first = _layers(code, seeds, top)[:, 0]
        for e in range(4):
            for q in range(4):
                has = first >> np.uint16(4 * e + q) & np.uint16(1) > 0
                out[part, q, e] = np.where(has.any(axis=0), has.argmax(axis=0), NEVER)
    return out


def traces(codes: list[bytes], ends: np.ndarray, entries: list[tuple[int, ...]]) -> list[dict[int, tuple[str, int]]]:
    """For each segment and each of its entry states: the least audit among the cheapest ways on, and the state after it.

    ``ends`` are the costs of going on from each state after the segment. Edits of rows are parted by
    commas; each is an initial with the initial of the role that it sets, or a dot.
    """
    out: list[dict[int, tuple[str, int]]] = [{} for _ in codes]
    ends = ends - ends.min(axis=1, keepdims=True)
    for part, code in _tables(codes):
        own = ends[part]
        top = DELETE * len(code) + int(own.max())
        seeds = ((own.T[None] == np.arange(own.max() + 1)[:, None, None]) << np.arange(4)[None, :, None]).sum(axis=1).astype(np.uint16)
        table = _layers(code, seeds, top)
        for k, j in enumerate(part):
            layers, row_codes = table[:, :, k].tolist(), codes[j]
            for q in entries[j]:
                left = next(c for c in range(top + 1) if layers[c][0] >> q & 1)
                out[j][q] = _trace(layers, row_codes, q, left)
    return out


def _trace(layers: list[list[int]], codes: bytes, state: int, left: int) -> tuple[str, int]:
    said, own, i = [], "", 0
    while i < len(codes):
        code = codes[i]
        late = LATE if code & IS_LATE else 0
        stays, kept, chosen = not code & (IS_BLANK | IS_COPY), KEPT.get((state, code & 3)), CHOSEN[state]
        tries = (
            ("D.", DELETE, state, 1), ("I" + INITIALS[chosen], INSERT, chosen, 0),
            *((("K.", late, kept, 1),) if stays and kept is not None else ()), *((("R" + INITIALS[chosen], REROLE + late, chosen, 1),) if stays else ()),
        )
        edit, cost, state, step = next(t for t in tries if left >= t[1] and layers[left - t[1]][i + t[3]] >> t[2] & 1)
        own, left, i = own + edit, left - cost, i + step
        if step:
            said.append(own)
            own = ""
    return ",".join(said), state


def _streamed(df: DataFrame, start: Callable[[], Callable], schema: str) -> DataFrame:
    """``mapInArrow`` over the rows of sorted partitions: ``start`` gives a function from rows to rows, made anew in each task."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            found = step(batch)
            if found is not None and len(found[0]):
                yield pa.RecordBatch.from_arrays(found, names)

    return df.mapInArrow(run, schema)


def _segments(kind: str) -> Callable:
    def start() -> Callable:
        def step(batch: pa.RecordBatch) -> list:
            conv, pos, code = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.uint8)
            of = pc.dictionary_encode(conv, null_encoding="encode").indices.to_numpy()
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (pos[1:] != pos[:-1] + 1)])
            runs = np.flatnonzero(new)
            place = np.arange(len(pos)) - np.repeat(runs, np.diff([*runs, len(pos)]))
            begins = np.flatnonzero(place % SEGMENT == 0)
            ends = np.append(begins[1:], len(pos))
            first = np.concatenate([[False], (of[1:] != of[:-1]) & (pos[1:] == pos[:-1] + 1)])[begins]  # sure only after the row before
            codes = [code[b:e].tobytes() for b, e in zip(begins, ends, strict=True)]
            costs = crossing_costs(codes)
            total = lambda x: np.add.reduceat(x.astype(np.int64), begins)
            initial = code & 3
            pair = np.concatenate([[0], initial[:-1] * 4 + initial[1:]])
            wrong = ~np.isin(pair, [a * 4 + b for a, b in LEGAL])
            wrong[begins] = False
            fault = [code & IS_BLANK > 0, code & IS_COPY > 0, code & IS_LATE > 0]
            columns = [pa.array(pos[begins]), pa.array(codes, pa.binary()), pa.array([c.tobytes() for c in costs], pa.binary()), pa.array(first), *(pa.array(total(x)) for x in (*fault, wrong))]
            return [conv.take(pa.array(begins)), *columns]

        return step

    return start, f"conv_id {kind}, pos long, codes binary, costs binary, first boolean, blank long, duplicate long, truncated long, illegal long"


def _backwards(kind: str) -> Callable:
    """Costs of going on after each segment of a conversation, from its last one to its first."""

    def start() -> Callable:
        conv, costs, after = object(), None, None

        def step(batch: pa.RecordBatch) -> list:
            nonlocal conv, costs, after
            ends, total, last, wrong = [], [], [], []
            for own, codes, crossing, illegal in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "codes", "costs", "illegal")), strict=True):
                last.append(own != conv)
                if own != conv:
                    conv, costs, after = own, np.array(CLOSED, np.int64), None
                ends.append(costs.tobytes())
                wrong.append(illegal + (after is not None and (codes[-1] & 3, after) not in LEGAL))
                costs = (np.frombuffer(crossing, np.int64).reshape(4, 4) + costs).min(axis=1)
                after = codes[0] & 3
                total.append(int(costs[START]))
            same = [batch.column(c) for c in ("conv_id", "pos", "codes", "first", "blank", "duplicate", "truncated")]
            return [*same, pa.array(wrong, pa.int64()), pa.array(ends, pa.binary()), pa.array(total, pa.int64()), pa.array(last)]

        return step

    return start, f"conv_id {kind}, pos long, codes binary, first boolean, blank long, duplicate long, truncated long, illegal long, ends binary, cost long, last boolean"


def _traced(kind: str) -> Callable:
    def start() -> Callable:
        def step(batch: pa.RecordBatch) -> list:
            column = lambda c: batch.column(c).to_pylist()
            ends = np.frombuffer(b"".join(column("ends")), np.int64).reshape(-1, 4)
            found = traces(column("codes"), ends, [(START,) if f else (0, 1, 2, 3) for f in column("first")])
            closing = [CLOSING if x else ("",) * 4 for x in column("last")]
            edits = [[f[q][0] + c[f[q][1]] if q in f else None for q in range(4)] for f, c in zip(found, closing, strict=True)]
            states = [[f[q][1] if q in f else None for q in range(4)] for f in found]
            same = [batch.column(c) for c in ("conv_id", "pos", "blank", "duplicate", "truncated", "illegal", "cost", "last")]
            return [*same, pa.array(edits, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32()))]

        return step

    return start, f"conv_id {kind}, pos long, blank long, duplicate long, truncated long, illegal long, cost long, last boolean, edits array<string>, states array<int>"


def _forwards(kind: str) -> Callable:
    """The edits of each segment from the state that the one before it leaves, and the whole audit at the last."""

    def start() -> Callable:
        conv, state, said = object(), START, []

        def step(batch: pa.RecordBatch) -> list:
            nonlocal conv, state, said
            chosen, cost, audit = [], [], []
            for own, edits, states, total, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edits", "states", "cost", "last")), strict=True):
                cost.append(0 if own == conv else total)
                if own != conv:
                    conv, state, said = own, START, []
                chosen.append(edits[state])
                said.append(edits[state].replace(",", "")[::2])
                state = states[state]
                audit.append("".join(said) if last else "")
            same = [batch.column(c) for c in ("conv_id", "pos", "blank", "duplicate", "truncated", "illegal")]
            return [*same, pa.array(cost, pa.int64()), pa.array(chosen, pa.string()), pa.array(audit, pa.string())]

        return step

    return start, f"conv_id {kind}, pos long, blank long, duplicate long, truncated long, illegal long, cost long, edits string, audit string"


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of repaired conversations, and a report of each conversation with the edits.

    conversations: conv_id, turn (a number), role, text; other columns are not read. A null role or text
    is one space. Rows of a conversation stand in the order of turn, nulls first, then of role and text. A
    null conv_id is a conversation of its own. The first fault of a row counts: blank (no
    ``[^\\x20\\x09-\\x0D]``), duplicate (an earlier row has its role and text), truncated (the last such character is
    not one of ``.!?``). Edits are Keep (0), Rerole to user or assistant (3), Delete (4; blank and
    duplicate rows have to go) and Insert of an empty user or assistant turn (3); a truncated row that stays
    adds 3. The initials of the roles have to match ``(s?(ua)+)?`` afterwards, at the least cost; among
    the cheapest audits, the edits' initials in order, the least in ASCII order is taken.

    Turns: conv_id, pos and sub (their order), role, text, edit. Report: conv_id, gaps (largest less
    smallest turn, plus one, less the number of different turns; nulls don't count), blank, duplicate,
    truncated, illegal (neighbours whose initials are not su, ua or au), cost, audit. An empty table
    gives no rows.

    Rows are sorted by range, so a conversation of any length lies in as many tasks as it needs, and
    are cut into segments of 16. For each segment, layers of rising cost hold bitsets of the grammar's states
    at each row; the first layers with a bit give its costs from state to state. These
    are chained from the last segment of a conversation to its first, as one small row a segment; the
    first layer of the whole gives the cost. With what lies behind it known, each segment is traced through its
    layers on its own, from each state; a pass over the segments picks those that follow each other.
    """
    kind = dict(conversations.dtypes)["conv_id"]
    rows = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    order = ["conv_id", "turn", "role"]
    rows = rows.repartitionByRange(*order, F.left("text", F.lit(32))).sortWithinPartitions(*order, "text").withColumn("pos", F.monotonically_increasing_id())
    rows = materialise(rows, "turns")

    bare = F.rtrim("text", F.lit(BLANK))
    initial = F.left("role", F.lit(1))
    known = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    slim = rows.select("conv_id", "pos", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), known.alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("late"))
    same = ["conv_id", "role", "digest"]
    repeated = keep(slim.groupBy(same).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    r = repeated.select(*(F.col(c).alias(f"{c}_") for c in same), "first")
    copies = slim.join(r, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in same]).filter("pos > first").select("pos", F.lit(True).alias("copy"))
    code = F.col("initial") + F.when(F.col("blank"), IS_BLANK).when(F.col("copy"), IS_COPY).when(F.col("late"), IS_LATE).otherwise(0)
    coded = slim.join(copies, "pos", "left").select("conv_id", "pos", code.alias("code"), F.shiftright("pos", BLOCK).alias("block"))

    cut = _streamed(coded.repartition("block").sortWithinPartitions("pos").select("conv_id", "pos", "code"), *_segments(kind))
    ended = _streamed(cut.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("pos")), *_backwards(kind))
    traced = _streamed(ended.repartition("conv_id", "pos"), *_traced(kind))
    chosen = materialise(_streamed(traced.repartition("conv_id").sortWithinPartitions("conv_id", "pos"), *_forwards(kind)), "edits", (repeated,))

    edits = chosen.select(F.posexplode(F.split("edits", ",")).alias("i", "own"), "pos").select((F.col("pos") + F.col("i")).alias("pos"), "own")
    each = F.posexplode(F.filter(F.regexp_extract_all("own", F.lit("(..)"), F.lit(1)), lambda e: e != "D.")).alias("sub", "edit")
    turns = rows.join(edits, "pos").select("conv_id", "pos", each, "role", "text")
    put, by = F.left("edit", F.lit(1)), F.right("edit", F.lit(1))
    role = F.when(by == "u", "user").when(by == "a", "assistant").otherwise(F.col("role"))
    turns = turns.select("conv_id", "pos", "sub", role.alias("role"), F.when(put == "I", "").otherwise(F.col("text")).alias("text"), put.alias("edit"))

    gaps = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    parts = chosen.select("conv_id", F.lit(0).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    parts = parts.unionByName(gaps.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), *zero, F.lit("").alias("audit")))
    report = parts.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.max("audit").alias("audit"))
    return turns, report


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and sha256 (lowercase hex) of the turns ``role:text`` of each conversation, joined by newlines: a stream over sorted rows, whatever their number."""
    kind = dict(turns.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = object(), None
        schema = None
        for batch in batches:
            schema, done = batch.schema.field(0).type, []
            for own, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != conv or digest is None:
                    if digest:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = own, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    digest.update(f"\n{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], schema), pa.array([d[1] for d in done])], ["conv_id", "sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([conv], schema), pa.array([digest.hexdigest()])], ["conv_id", "sha256"])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "sub").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, sha256 string")


def whole_report(ids: DataFrame, turns: DataFrame, report: DataFrame) -> DataFrame:
    """The report with ``repaired_sha256``, for every conv_id of ``ids``: one that has no rows has zeros, no audit and the hash of nothing."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = [F.lit(0).cast("long").alias(c) for c in counts]
    parts = ids.select("conv_id").distinct().select("conv_id", *nothing, F.lit("").alias("audit"), F.lit("").alias("sha"))
    parts = parts.unionByName(report.select("conv_id", *counts, "audit", F.lit("").alias("sha")))
    parts = parts.unionByName(digests(turns).select("conv_id", *nothing, F.lit("").alias("audit"), F.col("sha256").alias("sha")))
    sha: Column = F.coalesce(F.nullif(F.max("sha"), F.lit("")), F.lit(hashlib.sha256(b"").hexdigest()))
    return parts.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in counts), F.max("audit").alias("audit"), sha.alias("repaired_sha256"))
