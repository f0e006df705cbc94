"""Repair of conversations against a plain search over all edits."""

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from serieslab.llm import queries, turns

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def damaged(found):
    out = []
    for conv, turn, role, text in found:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(":".join(shown).encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def plain(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit and hash of one conversation's rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    numbers = [r[1] for r in rows if r[1] is not None]
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, state, inserted):
        """Least (cost, audit, turns) from row i on, after a turn with the initial ``state``."""
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        put = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[put]

        def add(cost, letter, rest, turn=None):
            ways.append((cost + rest[0], letter + rest[1], ((turn,) if turn else ()) + rest[2]))

        if inserted < 2:
            add(3, "I", best(i, put, inserted + 1), f"{name}:")
        if i < len(rows):
            role, text = rows[i][2:]
            add(4, "D", best(i + 1, state, 0))
            if faults[i] in ("", "truncated"):
                late = 3 if faults[i] else 0
                if role[:1] and role[:1] in NEXT[state]:
                    add(late, "K", best(i + 1, role[:1], 0), f"{role}:{text}")
                add(3 + late, "R", best(i + 1, put, 0), f"{name}:{text}")
        return min(ways, default=(10**9, "", ()))

    for i in range(len(rows), -1, -1):  # fills the cache from the end, so that recursion stays flat
        for state in NEXT:
            best(i, state, 0)
    cost, audit, kept = best(0, "", 0)
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def want_of(found, ids):
    groups = defaultdict(list)
    for r in found:
        groups[r[0]].append(r)
    return {i: plain(groups[i]) for i in ids}


def got_of(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def run(frame, rows):
    repaired, report = turns.repair(rows)
    return turns.whole_report(frame, repaired, report)


def conversations(rng, n, longest, some=("Yes.", "No", "", " \n", "Go on!", "what", "Well?", None)):
    found = []
    for conv in [None, *range(n)]:
        turn = 0
        for _ in range(rng.randint(0, longest)):
            turn += rng.choice([0, 1, 1, 1, 1, 3])
            found.append((conv, rng.choice([turn] * 12 + [None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice([*some, f"t{rng.random()}."])))
    return found


@pytest.mark.parametrize("longest", [6, 20, 70])
def test_random_conversations(spark, longest):
    found = conversations(random.Random(longest), 400 // longest + 20, longest)
    frame = spark.createDataFrame(found, SCHEMA).repartition(5)
    assert got_of(run(frame, frame)) == want_of([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in found], {r[0] for r in found})


@pytest.mark.parametrize("most, block", [(16, 13), (3, 13), (5, 2)])
def test_one_long_conversation(spark, monkeypatch, most, block):
    """Hundreds of turns over many segments and blocks of rows, with whole partitions of one conversation."""
    monkeypatch.setattr(turns, "SEGMENT", most)
    monkeypatch.setattr(turns, "BLOCK", block)
    rng = random.Random(3)
    found = [(7, i, rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][i % 2], rng.choice(["Yes.", "No", f"t{i}.", f"u{i}!", ""])) for i in range(300)] + [(8, 0, "user", "a."), (6, 0, "assistant", "b.")]
    frame = spark.createDataFrame(found, SCHEMA).repartition(3)
    assert got_of(run(frame, frame)) == want_of(found, {6, 7, 8})


def test_damage(spark):
    found = conversations(random.Random(9), 80, 8)
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in found], SCHEMA + ", pos int, code string, edits string")
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, turns.damage(frame).collect()), key=key) == sorted(damaged(found), key=key)
    assert got_of(run(frame, turns.damage(frame))) == want_of(damaged(found), {r[0] for r in found})


def test_turns_are_the_repaired_ones(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "So?"), (1, 2, "user", "Then?"), (1, 3, "assistant", "")]
    got, report = turns.repair(spark.createDataFrame(rows, SCHEMA))
    assert [(r.role, r.text, r.edit) for r in got.orderBy("pos", "sub").collect()] == [("user", "", "I"), ("assistant", "Hello.", "K"), ("user", "So?", "K"), ("assistant", "Then?", "R")]
    assert report.first().audit == "IKKRD"


def test_nothing_and_lost_conversations(spark):
    frame = spark.createDataFrame([], SCHEMA)
    repaired, report = turns.repair(frame)
    assert repaired.count() == report.count() == turns.whole_report(frame, repaired, report).count() == 0
    ids = spark.createDataFrame([(5, 0, "user", "x")], SCHEMA)
    assert got_of(run(ids, frame)) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query(spark, sf):
    found = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select(*(c.split(" ")[0] for c in SCHEMA.split(", "))).collect()]
    assert got_of(queries.op11_turns(spark, sf)) == want_of(damaged(found), {r[0] for r in found})


def test_very_long_text(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b.")], SCHEMA).withColumn("text", F.repeat("text", 2_000_000))
    assert got_of(run(frame, frame))[1][5:7] == (3, "KK")
