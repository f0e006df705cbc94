"""Near-duplicate components: SetSketch registers, bands, likelihood estimates, exact confirmation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslab.llm import bloom
from serieslab.llm.common import arrow_map, keep, materialise, row_id, splitmix
from serieslab.llm.components import connected
from serieslab.llm.decontaminate import gram_hashes
from serieslab.llm.words import NOT_BLANK, Words, lowered, together

#: SetSketch parameters: number of registers, base of the exponential spacing, rate, largest register.
REGISTERS, BASE, RATE, LARGEST = 256, 1.001, 20.0, (1 << 16) - 1
#: Bands over the first BANDS * ROWS registers; at similarity 0.8 no band agrees once in 20 million pairs.
BANDS, ROWS = 32, 4
#: Members of one block on either side of a comparison within a bucket.
BLOCK = 1024

_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_ODD = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct k-word shingles of each (lower-cased) text."""
    out = []
    for _, part in together(texts):
        words = Words(part, NOT_BLANK)
        hashes = words.hashes()
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            out.append(np.unique(gram_hashes(hashes[a:b], min(k, b - a))) if b > a else hashes[:0])
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """For each register the least hash over the set; the minima of a union are the least of its parts'."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(least, ((short[at : at + 1024, None] ^ _XOR) * _ODD).min(axis=0), out=least)
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """Registers of a SetSketch: each minimum as that of exponential variates, on an exponential scale, truncated."""
    e = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(e) / math.log(BASE)), 0, LARGEST).astype(np.uint16)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each sketch."""
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40), (len(sketches), BANDS))
    for j in range(ROWS):
        out = splitmix(out + sketches[:, j : BANDS * ROWS : ROWS])
    return out


def estimate(larger: np.ndarray, smaller: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """Jaccard similarity of greatest likelihood, given how many registers of U are larger and smaller than V's.

    With the exact sizes of both sets a register of U is larger with probability p(u - v j), where
    p(x) = -log_b(1 - x (b - 1) / b) and u, v are the sizes' shares of their sum.
    """
    u = (n_u / (n_u + n_v))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 201) * np.minimum(u / v, v / u)
    p = lambda x: np.maximum(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE), 1e-9)
    up, down = p(u - v * j), p(v - u * j)
    likely = larger[:, None] * np.log(up) + smaller[:, None] * np.log(down) + (REGISTERS - larger - smaller)[:, None] * np.log(np.maximum(1 - up - down, 1e-9))
    return np.take_along_axis(j, likely.argmax(axis=1)[:, None], 1)[:, 0]


def possible(threshold: float) -> float:
    """Estimates below this are of pairs below ``threshold``: five standard deviations of the estimate."""
    return threshold - 5 * math.sqrt(threshold * (1 - threshold) / REGISTERS)


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _sketch(k: int) -> callable:
    def make() -> callable:
        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(lowered(batch.column(2)), k)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([registers(minima(s)).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["row", "doc_id", "n", "key", "regs"],
            )

        return of

    return make


def _bands() -> callable:
    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = band_keys(_regs(batch.column(1))).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], ["key", "bands"])

    return of


def _estimated(cut: float) -> callable:
    def make() -> callable:
        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = _regs(batch.column(2)), _regs(batch.column(3))
            j = estimate((a > b).sum(axis=1), (a < b).sum(axis=1), batch.column(4).to_numpy(), batch.column(5).to_numpy())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(j >= cut))

        return of

    return make


def similar(x: np.ndarray, y: np.ndarray, hundredths: int) -> bool:
    """Whether two sorted sets without repeats have a Jaccard similarity of so many hundredths or more."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= hundredths * (len(x) + len(y) - both)


def _confirmed(threshold: float) -> callable:
    """Links of rows (centre, salt, leads, other, shingles) in this order: a centre's own set, then those of its candidates."""
    hundredths = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = None, None
        for batch in batches:
            out = []
            for centre, leads, other, shingles in zip(*(batch.column(j).to_pylist() for j in (0, 2, 3, 4)), strict=True):
                if leads:
                    own, known = centre, np.frombuffer(shingles, np.uint64)
                elif own == centre and similar(known, np.frombuffer(shingles, np.uint64), hundredths):
                    out.append((min(centre, other), max(centre, other)))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.binary()), pa.array([p[1] for p in out], pa.binary())], ["a", "b"])

    return run


class Unit:
    """Part of a bucket: a block of members outside its largest component (left) against a block of all."""

    def __init__(self, group: pa.Table) -> None:
        left = np.array(group.column("left").to_pylist(), bool)
        keys, regs = np.array(group.column("key").to_pylist(), object), _regs(group.column("regs"))
        roots, n = np.array(group.column("root").to_pylist(), object), group.column("n").to_numpy()
        minor, bands = np.array(group.column("minor").to_pylist(), bool), band_keys(regs).view(np.int64)
        self.band = group.column("band")[0].as_py()
        self.at = np.flatnonzero(left), np.flatnonzero(~left)
        self.keys, self.roots, self.regs, self.n, self.minor, self.bands = keys, roots, regs, n, minor, bands

    def pairs(self, cut: float) -> Iterator[tuple[int, np.ndarray]]:
        """For each member on the left, those on the right of other components that may be similar.

        A pair that shares several buckets is taken in the one of its first common band only; of two
        members outside the largest component the one with the smaller key is the left one.
        """
        left, right = self.at
        for i in left:
            js = right[(self.roots[right] != self.roots[i]) & (~self.minor[right] | (self.keys[right] > self.keys[i]))]
            common = self.bands[js] == self.bands[i]
            js = js[self.bands[i][common.argmax(axis=1)] == self.band]
            js = js[(self.regs[js] == self.regs[i]).sum(axis=1) >= (cut - 0.1) * REGISTERS]  # about the similarity
            if len(js):
                j = estimate((self.regs[i] > self.regs[js]).sum(axis=1), (self.regs[i] < self.regs[js]).sum(axis=1), np.full(len(js), self.n[i]), self.n[js])
                js = js[j >= cut]
            if len(js):
                yield i, js


def _involved(cut: float) -> callable:
    """Members of a unit that have a possible pair in it: at most as many rows as the unit has."""

    def of(group: pa.Table) -> pa.Table:
        unit, found = Unit(group), set()
        for i, js in unit.pairs(cut):
            found.add(i)
            found.update(js.tolist())
        return group.take(pa.array(sorted(found), pa.int64()))

    return of


def _linked(cut: float, threshold: float) -> callable:
    """Links of a unit that join components: possible pairs are confirmed on full sets until they are joined."""
    hundredths = round(100 * threshold)

    def of(group: pa.Table) -> pa.Table:
        unit, parent, out = Unit(group), {}, []
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]

        def top(x: bytes) -> bytes:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        for i, js in unit.pairs(cut):
            for j in js:
                a, b = top(unit.roots[i]), top(unit.roots[j])
                if a != b and similar(sets[i], sets[j], hundredths):
                    parent[max(a, b)] = min(a, b)
                    out.append((min(a, b), max(a, b)))
        return pa.table({"a": pa.array([p[0] for p in out], pa.binary()), "b": pa.array([p[1] for p in out], pa.binary())})

    return of


def near_dedup(docs: DataFrame, k: int = 5, threshold: float = 0.8, max_bits: int = 1 << 28, row: str | None = None) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of ``threshold`` or more of their shingle sets.

    A-Z are lower-cased and words are ``[^\\x20\\x09-\\x0D]+``. The set of a document is its distinct
    ``k``-word shingles, or its whole word sequence if that is shorter; a text without words has an
    empty set and is linked with nothing. Returns for each row of ``docs``: row, doc_id, n_shingles,
    component_id (the smallest doc_id reachable, its own included), kept (true for exactly one row of a
    component: the first by doc_id and row, null ids last). A null doc_id is ignored when the smallest
    is sought. ``row`` names a column with a number of each row; without it rows are numbered here.
    Other columns are not read; an empty table gives no rows.

    1. One scan gives each document its set's digest and SetSketch; equal sets become one class.
    2. Bands of registers deal the classes to buckets. Each class is compared with two centres of each
       of its buckets, the smallest and the largest member: by the likelihood estimate from the sketches
       first, exactly on full sets for what remains. Linked classes become components.
    3. Buckets that still hold several components compare the members outside their largest component
       with all members of other components, block against block in separate tasks, on sketches; then
       the members that have a possible partner meet there with their full sets, and pairs that would
       join two components are confirmed exactly. So no link is lost between members of a bucket,
       while a large group of copies, which step 2 has joined, is not compared again. No table holds
       pairs; a bucket of n members that are unlike each other has n * n / BLOCK rows with sketches.

    The centres, pairs and components are tables in the shared folder; nothing of them is collected.
    """
    spark = docs.sparkSession
    cut = possible(threshold)
    rows = materialise(arrow_map(docs.select(row_id(row).alias("row"), "doc_id", "text"), _sketch(k), "row long, doc_id long, n long, key binary, regs binary"), "sketches")
    classes = rows.filter("key is not null").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = classes.withColumn("min_doc", F.col("first.doc_id"))
    classes = keep(classes)
    # aggregates are kept before they are joined by the same key, so that a bucket with very many members is split
    members = keep(arrow_map(classes.select("key", "regs"), _bands, "key binary, bands array<long>").select("key", F.explode("bands").alias("band")))
    centres = keep(members.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high"))
    shared = materialise(members.join(centres, "band"), "buckets", (members, centres))

    # the full sets of the classes that share a bucket, from one document of each
    wanted = shared.select("key").distinct().join(classes.select("key", "min_doc"), "key")
    wanted = keep(wanted.select("min_doc"))
    bits = bloom.bits_for(wanted.count(), max_bits)

    def ids(batch: pa.RecordBatch) -> np.ndarray:
        return splitmix(pc.fill_null(batch.column(0), -1).to_numpy(zero_copy_only=False).view(np.uint64))

    table = spark.sparkContext.broadcast(bloom.build(wanted, ids, bits, "once"))

    def full() -> callable:
        own = table.value

        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).filter(pa.array(bloom.contains(own, bits, ids(batch))))
            sets = [x for x in shingle_sets(lowered(texts), k) if len(x)]
            return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "shingles"])

        return of

    sets = arrow_map(docs.select("doc_id", "text"), full, "key binary, shingles binary")
    sets = materialise(sets.dropDuplicates(["key"]), "sets")

    small = classes.select("key", "regs", "n")

    def star(centre: str) -> DataFrame:
        return shared.filter(F.col("key") != F.col(centre)).select(F.col(centre).alias("a"), F.col("key").alias("b"))

    pairs = star("low").unionByName(star("high")).distinct()
    one, two = (small.select(F.col("key").alias(x), F.col("regs").alias(f"r{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    pairs = arrow_map(pairs.join(one, "a").join(two, "b").select("a", "b", "ra", "rb", "na", "nb"), _estimated(cut), "a binary, b binary")
    pairs = materialise(pairs, "candidates")  # a stage runs one kind of Python worker only

    # a candidate's set goes to its centre; a centre's goes once to each part of its candidates
    counted = keep(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")))
    leads = counted.join(sets.withColumnRenamed("key", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(True).alias("leads"), F.col("a").alias("b"), "shingles")
    dealt = keep(pairs.join(counted, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), F.lit(False).alias("leads"), "b"))
    rows_of = leads.unionByName(dealt.join(sets.withColumnRenamed("key", "b"), "b").select("a", "salt", "leads", "b", "shingles"))
    ordered = rows_of.repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("leads"))
    roots = keep(connected(ordered.mapInArrow(_confirmed(threshold), "a binary, b binary")))

    # buckets with several components: members outside the largest against all
    labelled = shared.select("band", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    labelled = materialise(labelled, "labelled")
    sizes = labelled.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c"))
    open_ = sizes.groupBy("band").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    open_ = keep(open_.select("band", F.col("most.root").alias("major"), F.col("all"), (F.col("all") - F.col("most.c")).alias("minors")))
    inside = labelled.join(open_, "band").withColumn("minor", F.col("root") != F.col("major")).join(small, "key")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("key", F.lit(n)), blocks(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    columns = ["band", "i", "j", "left", "key", "root", "n", "regs", "minor"]
    left = inside.filter("minor").withColumn("left", F.lit(True)).withColumn("i", own("minors")).withColumn("j", others("all")).select(columns)
    right = inside.withColumn("left", F.lit(False)).withColumn("j", own("all")).withColumn("i", others("minors")).select(columns)
    units = left.unionByName(right).groupBy("band", "i", "j")
    involved = units.applyInArrow(_involved(cut), "band long, i int, j int, left boolean, key binary, root binary, n long, regs binary, minor boolean")
    involved = keep(involved)
    found = involved.join(sets, "key").groupBy("band", "i", "j").applyInArrow(_linked(cut, threshold), "a binary, b binary")
    label = roots.withColumnRenamed("node", "key")
    above = keep(connected(found))
    label = classes.select("key", "first").join(label, "key", "left").withColumn("root", F.coalesce("root", "key"))
    label = label.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    label = label.select("key", "first", F.coalesce("top", "root").alias("top"))
    least = label.groupBy("top").agg(F.min("first").alias("least"))
    used = (classes, shared, wanted, sets, pairs, counted, dealt, roots, labelled, open_, involved, above)
    final = materialise(label.join(least, "top").select("key", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("stays")), "final", used)
    out = rows.select("row", "doc_id", "n", "key").join(final, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("row", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("key").isNull() | F.coalesce(F.col("row") == F.col("stays"), F.lit(False))).alias("kept"))
