"""Which words of a catalogue a text contains, by automata over all words at once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of words of one automaton, which takes some fifty times as much, and bytes of texts that meet it in one group.
MOST_BYTES, PART_BYTES = 4 << 20, 64 << 20
#: What each word takes besides its letters.
OVERHEAD = 16
_built: dict[str, Callable] = {}


def _automaton(words: list[str]) -> object:
    import ahocorasick

    made = ahocorasick.Automaton()
    for w in words:
        made.add_word(w, w)
    made.make_automaton()
    return made


def _finder(words: list[str], longest: bool) -> Callable[[list[str]], tuple[list[int], list[str]]]:
    """A function that gives, for texts, (number of the text, word) of the words that each contains."""
    made = _automaton(words) if words else None

    def find(texts: list[str]) -> tuple[list[int], list[str]]:
        at, found = [], []
        for i, t in enumerate(texts if made else ()):
            own = {w for _, w in made.iter(t)}
            if longest and own:
                most = max(map(len, own))
                own = {w for w in own if len(w) == most}
            at += [i] * len(own)
            found += own
        return at, found

    return find


def contained(texts: DataFrame, text: str, words: DataFrame, word: str, longest: bool = False, most_bytes: int = MOST_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Pairs (``text``, ``word``) of distinct texts and the distinct words that they contain.

    Words of up to ``most_bytes`` are broadcast and each Python worker makes one Aho-Corasick automaton
    of them, through which its texts run once, whatever the number of words. More words are divided by
    their first character into shards of about that size; a character with too many words is divided by hash on.
    A text goes to the shards of the characters that it has, in parts of about ``part_bytes``, and meets each shard's
    automaton there: both sides of a group have a bound. Null or empty words and null texts are in no pair.
    With ``longest`` an automaton leaves out words that are shorter than another one of its own in the same text.
    """
    spark = texts.sparkSession
    texts = texts.select(F.col(text).alias("t")).filter("t is not null").distinct()
    words = words.select(F.col(word).alias("w")).filter("w <> ''").distinct()
    sizes = words.groupBy(F.left("w", F.lit(1)).alias("c")).agg(F.sum(F.octet_length("w") + OVERHEAD).alias("n")).orderBy("c").collect()
    schema = "t string, w string"
    if sum(r.n for r in sizes) <= most_bytes:
        sent, name = spark.sparkContext.broadcast([r.w for r in words.collect()]), uuid.uuid4().hex  # size checked just before

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if name not in _built:  # once in a worker process, which stays for later tasks
                _built.clear()
                _built[name] = _finder(sent.value, longest)
            find = _built[name]
            for batch in batches:
                at, found = find(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(found, pa.string())], ["t", "w"])

        pairs = texts.mapInArrow(run, schema)
        return pairs.select(F.col("t").alias(text), F.col("w").alias(word))

    shards, filled, number = {}, 0, 0  # character -> its first shard and how many there are
    for r in sizes:
        if filled + r.n > most_bytes and filled:
            number, filled = number + 1, 0
        many = -(-r.n // most_bytes)
        shards[r.c] = (number, many)
        filled += r.n
        if many > 1:
            number, filled = number + many, 0
    of = spark.createDataFrame([(c, list(range(a, a + n))) for c, (a, n) in shards.items()], "c string, shards array<int>")
    parts = -(-(texts.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0] or 1) // part_bytes)
    mapped = spark.sparkContext.broadcast({c: range(a, a + n) for c, (a, n) in shards.items()})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = [sorted({s for c in set(t) if c in mapped.value for s in mapped.value[c]}) for t in batch.column(0).to_pylist()]
            at = [i for i, own in enumerate(to) for _ in own]
            yield pa.RecordBatch.from_arrays([pa.array([s for own in to for s in own], pa.int32()), batch.column(0).take(pa.array(at, pa.int32()))], ["shard", "t"])

    part = F.pmod(F.xxhash64("t"), F.lit(parts)).cast("int")
    dealt = texts.mapInArrow(spread, "shard int, t string").withColumn("part", part)
    placed = words.withColumn("c", F.left("w", F.lit(1))).join(F.broadcast(of), "c").select("w", F.get("shards", F.pmod(F.xxhash64("w"), F.size("shards")).cast("int")).alias("shard"))
    placed = placed.select("shard", "w", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        at, found = _finder(right.column("w").to_pylist(), longest)(left.column("t").to_pylist())
        return pa.table({"t": left.column("t").take(pa.array(at, pa.int32())), "w": pa.array(found, pa.string())})

    pairs = dealt.groupBy("shard", "part").cogroup(placed.groupBy("shard", "part")).applyInArrow(meet, schema)
    return pairs.select(F.col("t").alias(text), F.col("w").alias(word))
