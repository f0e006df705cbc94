"""Mixing sources to target weights as a min-cost flow over membership patterns."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serieslab.llm.common import materialise, row_id

#: Seeded order: documents fall into so many hash buckets of their pattern.
BUCKETS = 4096
#: Words of a text, and membership patterns up to which their plan is broadcast.
WORD, FEW_PATTERNS = r"[^\x20\x09-\x0D]+", 10_000
#: Passes in seeded order; each leaves a gap smaller than a document that fitted before.
ROUNDS = 2
#: Times that the gap after the passes is closed by documents of falling size, one of each power of two.
FILLS = 3


def capped_targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Shares of ``total`` by weight, none above ``most`` times its source's size.

    The excess of capped sources is shared among the others by weight until none is above.
    """
    open_, left, out = {s for s in sizes if sizes[s] > 0}, float(total), dict.fromkeys(sizes, 0.0)
    while open_:
        per = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * per > most * sizes[s]}
        if not over:
            return out | {s: weights[s] * per for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def route(patterns: dict[tuple, int], quotas: dict, most: int) -> dict[tuple, int]:
    """Tokens to take from each membership pattern so that the sources reach their quotas: a min-cost flow.

    The network: a pattern offers its tokens once for each allowed repetition, each repetition dearer
    than the one before (so the cost is convex and no token is repeated while a fresh one serves the
    same quota); it may serve any of its sources; a source takes its quota. Only offers cost anything,
    so an augmenting path costs what its first pattern's offer does, and the cheapest paths in turn are
    those of the first repetition, then those of the second, and so on: each repetition adds its
    offers and the flow is made largest by blocking flows along shortest paths.
    """
    names, number = list(patterns), {s: i for i, s in enumerate(quotas)}
    members = [[number[s] for s in p] for p in names]
    room, left = [round(q) for q in quotas.values()], [0] * len(names)
    flow, into = [[0] * len(m) for m in members], [[] for _ in room]
    for p, m in enumerate(members):
        for k, s in enumerate(m):
            into[s].append((p, k))
    for _ in range(most):
        left = [n + int(patterns[p]) for n, p in zip(left, names, strict=True)]
        while (depths := _layers(members, into, flow, left, room)) is not None:
            _block(members, into, flow, left, room, *depths)
    return {p: sum(f) for p, f in zip(names, flow, strict=True)}


def _layers(members: list, into: list, flow: list, left: list, room: list) -> tuple[list, list] | None:
    """Depth of each pattern and source in the residual network, up to the first source with room; None without one."""
    of_pattern, of_source, depth = [-1] * len(members), [-1] * len(room), 0
    front = [p for p, n in enumerate(left) if n > 0]
    for p in front:
        of_pattern[p] = 0
    while front:
        reached = []
        for p in front:
            for s in members[p]:
                if of_source[s] < 0:
                    of_source[s] = depth
                    reached.append(s)
        if any(room[s] > 0 for s in reached):
            return of_pattern, of_source
        front, depth = [], depth + 1
        for s in reached:
            for p, k in into[s]:
                if of_pattern[p] < 0 and flow[p][k] > 0:
                    of_pattern[p] = depth
                    front.append(p)
    return None


def _block(members: list, into: list, flow: list, left: list, room: list, of_pattern: list, of_source: list) -> None:
    """A blocking flow along the layers; an arc that leads nowhere is not tried again."""
    next_source, next_arc = [0] * len(members), [0] * len(room)
    for start in [p for p, n in enumerate(left) if n > 0]:
        path, p = [], start  # arcs pattern -> source, and between them the arc of the next pattern that gives way
        while left[start] > 0:
            m = members[p]
            while next_source[p] < len(m) and of_source[m[next_source[p]]] != of_pattern[p]:
                next_source[p] += 1
            if next_source[p] == len(m):
                if not path:
                    break
                path.pop()
                back = path.pop()
                next_arc[members[back[0]][back[1]]] += 1
                p, at = back[0], back
            else:
                at = (p, next_source[p])
            s = members[at[0]][at[1]]
            if room[s] > 0:
                path.append(at)
                amount = min(left[start], room[s], *(flow[q][k] for q, k in path[1::2]))
                for i, (q, k) in enumerate(path):
                    flow[q][k] += -amount if i % 2 else amount
                left[start] -= amount
                room[s] -= amount
                path, p = [], start
                continue
            arcs = into[s]
            while next_arc[s] < len(arcs) and not (flow[arcs[next_arc[s]][0]][arcs[next_arc[s]][1]] > 0 and of_pattern[arcs[next_arc[s]][0]] == of_source[s] + 1):
                next_arc[s] += 1
            if next_arc[s] == len(arcs):
                next_source[p] += 1
            else:
                path += [at, arcs[next_arc[s]]]
                p = arcs[next_arc[s]][0]


def _fill(group: pd.DataFrame) -> pd.DataFrame:
    """Of one pattern's candidates (at most one for each power of two of the size, and the smallest): those that close the gap."""
    gap, chosen = int(group["gap"].iloc[0]), []
    own = group.drop_duplicates("row").sort_values(["size", "u", "doc_id", "row"], ascending=[False, True, True, True])
    for row, size in zip(own["row"], own["size"], strict=True):
        if size <= gap:
            chosen.append(row)
            gap -= size
    rest = own[~own["row"].isin(chosen)]
    if len(rest) and gap > 0:
        near = rest.iloc[(rest["size"] - gap).abs().argmin()]
        if abs(near["size"] - gap) < gap:
            chosen.append(near["row"])
    return pd.DataFrame({"row": pd.Series(chosen, dtype="int64"), "filled": True})


def mix(docs: DataFrame, members: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3, budget: float = 1.0, seed: int = 0, row: str | None = None) -> DataFrame:
    """How often each document is taken so that the sources reach their target shares.

    ``members`` names the column with a document's source, or with an array of the sources it belongs
    to. The size of a document is its number of words ``[^\\x20\\x09-\\x0D]+`` (null text: 0). Sources
    in code point order, null last, get the weights in turn, over and over; together they are to reach
    ``budget`` times the size of all documents, no source over ``most`` times its own size (see
    :func:`capped_targets`), and no document is taken more than ``most`` times. A null array counts as the one source null; an
    empty array as no source, and its documents are not taken. Returns one row for each
    row of ``docs``: row, doc_id, members, size, copies, source_size and target (sums over its
    sources). An empty table gives no rows. Documents are ordered by a hash of doc_id and text and by
    doc_id, so the mix depends on the documents alone, not on how the table is split into files or tasks.
    ``row`` names a column with a number of each row; without it rows are numbered here. Other columns
    are not read.

    One scan counts words and leaves small rows. They are summed by membership pattern; the flow runs
    on the driver over the sums of the patterns, one row each, whatever their number. What a pattern gives beyond whole repetitions is repeated from the documents
    that fit into it, then taken in seeded hash order: bucket sums find the bucket where the rest is
    reached and only that bucket is sorted, so no pattern passes through one task. Documents of falling
    size then close the gap.
    """
    kind = dict(docs.dtypes)[members]
    none = F.array(F.lit(None).cast("string"))
    member = F.coalesce(F.col(members), none) if kind.startswith("array") else F.array(F.col(members).cast("string"))
    u = F.xxhash64(F.lit(seed), "doc_id", "text") % (BUCKETS << 32)
    rows = docs.select(row_id(row).alias("row"), "doc_id", F.array_sort(F.array_distinct(member)).alias("members"), F.abs(u).alias("u"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = materialise(rows, "mix-sizes")

    table = sized.groupBy("members").agg(F.sum("size").alias("n")).orderBy("members").toArrow()
    patterns = {tuple(p): n for p, n in zip(table.column("members").to_pylist(), table.column("n").to_pylist(), strict=True)}
    total, sizes = sum(patterns.values()), defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    targets = capped_targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, budget * total, most)
    flow = route(patterns, targets, most)
    plan = [(list(p), n and flow[p] // n or 0, n and flow[p] % n or 0, sum(sizes[s] for s in p), float(sum(targets[s] for s in p))) for p, n in patterns.items()]
    plan = docs.sparkSession.createDataFrame(plan, "members array<string>, copies long, rest long, source_size long, target double")
    key = F.to_json(F.struct("members"))  # null members compare as equal there
    hint = F.broadcast if len(patterns) <= FEW_PATTERNS else lambda x: x
    planned = sized.withColumn("key", key).join(hint(plan.withColumn("key", key).drop("members")), "key")

    # whole repetitions of the documents that fit into what is left
    fits = (F.col("size") <= F.col("rest")) & (F.col("size") > 0) & (F.col("copies") < most)
    pools = planned.filter(fits).groupBy("key").agg(F.sum("size").alias("pool"), F.first("rest").alias("rest"), F.first("copies").alias("copies"))
    again = pools.select("key", F.least(F.lit(most) - F.col("copies"), F.floor(F.col("rest") / F.col("pool"))).alias("again"), "pool")
    planned = planned.join(hint(again), "key", "left")
    planned = planned.withColumn("copies", F.col("copies") + F.when(fits, F.coalesce("again", F.lit(0))).otherwise(0)).withColumn("rest", F.col("rest") - F.coalesce(F.col("again") * F.col("pool"), F.lit(0)))
    state = materialise(planned.drop("again", "pool").withColumn("more", F.lit(False)), "mix-whole", (sized,))

    for _ in range(ROUNDS):
        state = materialise(_one_more_each(state, most, hint), "mix-round", (state,))
    # what is left is closed by documents of any size, those not taken in the passes first
    for _ in range(FILLS):
        state = materialise(_closed(state, most, hint), "mix-filled", (state,))
    return state.select("row", "doc_id", "members", "size", "copies", "source_size", "target")


def _closed(state: DataFrame, most: int, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One more copy of documents of falling size that fit into their pattern's ``rest``, which shrinks by them."""
    can = (F.col("size") > 0) & (F.col("rest") > 0) & (F.col("copies") < most)
    each = state.filter(can & (F.col("size") <= F.col("rest"))).groupBy("key", F.floor(F.log2("size")).alias("step")).agg(F.min(F.struct("more", "u", "doc_id", "row", "size", "rest")).alias("c"))
    least = state.filter(can).groupBy("key").agg(F.min(F.struct("size", "u", "doc_id", "row", "rest")).alias("c"))
    chosen = ["key", "c.row", "c.size", "c.u", "c.doc_id", F.col("c.rest").alias("gap")]
    filled = each.select(chosen).unionByName(least.select(chosen)).groupBy("key").applyInPandas(_fill, "row long, filled boolean")
    marked = state.join(filled, "row", "left").withColumn("filled", F.col("filled").isNotNull())
    used = marked.filter("filled").groupBy("key").agg(F.sum("size").alias("used"))
    out = marked.join(hint(used), "key", "left").withColumn("rest", F.col("rest") - F.coalesce("used", F.lit(0)))
    return out.withColumn("copies", F.col("copies") + F.col("filled").cast("long")).withColumn("more", F.col("more") | F.col("filled")).select(state.columns)


def _one_more_each(state: DataFrame, most: int, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One more copy of documents of each pattern in seeded order while they fit into its ``rest``, which shrinks by them.

    Sums of hash buckets, at most BUCKETS a pattern however large it is, find the bucket in which the
    rest is reached; only its rows are sorted.
    """
    bucket = F.shiftright("u", 32)
    open_ = ~F.col("more") & (F.col("size") > 0) & (F.col("size") <= F.col("rest")) & (F.col("copies") < most)
    sums = state.filter(open_).groupBy("key", bucket.alias("bucket"), "rest").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("key").orderBy("bucket")
    sums = sums.withColumn("before", F.sum("n").over(upto) - F.col("n")).filter("before <= rest and before + n > rest")
    cut = state.join(hint(sums.select("key", F.col("bucket").alias("cut"), "before")), "key", "left").withColumn("open", open_).withColumn("bucket", bucket)
    order = Window.partitionBy("key").orderBy("u", "doc_id", "row")
    within = cut.filter("open and bucket = cut").select("row", (F.col("before") + F.sum("size").over(order) <= F.col("rest")).alias("fit"))
    taken = F.col("open") & (F.col("cut").isNull() | (F.col("bucket") < F.col("cut")) | F.coalesce("fit", F.lit(False)))
    marked = cut.join(within, "row", "left").withColumn("taken", taken).drop("fit", "before", "cut", "bucket", "open")
    used = marked.filter("taken").groupBy("key").agg(F.sum("size").alias("used"))
    left = F.col("rest") - F.coalesce("used", F.lit(0))
    out = marked.join(hint(used), "key", "left").withColumn("rest", left).withColumn("copies", F.col("copies") + F.col("taken").cast("long")).withColumn("more", F.col("more") | F.col("taken"))
    return out.select(state.columns)
