"""Joins by precedence, by containment, by shared tokens, and within groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from serieslab.functions.text import given_name, name_tokens
from serieslab.operators import containment
from serieslab.session import stored


def by_precedence(df: DataFrame, dim: DataFrame, key: str, rank: Callable[[Column], Column]) -> DataFrame:
    """Each row of ``df`` with ``best``: the row of a small ``dim`` of its key that ranks lowest, null without one.

    ``rank`` maps a candidate (a struct of the columns of ``dim``, with ``ord``) to a number and may use
    columns of ``df``; ties go to the lower ``ord``. Candidates are gathered in the dimension first, so
    the join adds no rows and the large side is not shuffled; the best is picked inside the row.
    """
    candidate = F.struct(F.col("ord"), *(c for c in dim.columns if c not in ("ord", key)))
    listed = dim.groupBy(key).agg(F.array_sort(F.collect_list(candidate)).alias("_all"))
    joined = df.join(F.broadcast(listed), key, "left")
    ranked = F.transform("_all", lambda c: F.struct(rank(c).alias("rank"), c["ord"].alias("ord"), c.alias("c")))
    return joined.withColumn("best", F.array_min(ranked)["c"]).drop("_all")


#: Words up to which each text is compared with each, and characters of a text up to which its pieces are looked up among more words.
FEW, SHORT = 1_000, 32
#: Bytes of words, with OVERHEAD for each, up to which more than FEW of them are broadcast.
SENT, OVERHEAD = 1 << 20, 16


def _prefixes(text: Column, least: int, most: int) -> Column:
    """The beginnings of ``least`` to ``most`` characters of a text of ``least`` or more."""
    return F.transform(F.sequence(F.lit(least), F.least(F.length(text), F.lit(most))), lambda n: F.substr(text, F.lit(1), n))


def _suffixes(text: Column, least: int) -> Column:
    """The ends of ``least`` or more characters of a text of as many."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - least + 1), lambda i: F.substr(text, i))


def _pieces(text: str, least: int, most: int) -> Column:
    """The distinct pieces of ``least`` to ``most`` characters of a text of ``least`` or more."""
    return F.array_distinct(F.flatten(F.transform(_suffixes(F.col(text), least), lambda s: _prefixes(s, least, most))))


def _sizes(words: DataFrame, word: str) -> Row:
    """How many words there are, the fewest and most characters of one that has any, and the bytes of all."""
    size = F.length(word)
    return words.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min(F.when(size > 0, size)), F.lit(1)).alias("least"), F.greatest(F.max(size), F.lit(1)).alias("most"), F.coalesce(F.sum(F.octet_length(word) + OVERHEAD), F.lit(0)).alias("bytes")).first()


def _sent(words: DataFrame, size: int) -> DataFrame:
    """Words to be broadcast in a join if their measured size allows it, else to be shuffled.

    What the planner goes by is the size of files, without their compression and without what an explode makes of their rows.
    """
    return F.broadcast(words) if size <= SENT else words.hint("merge")


def containing(texts: DataFrame, text: str, words: DataFrame, word: str, few: int = FEW, longest: bool = False) -> DataFrame:
    """Rows of ``texts`` and ``words`` where the word is contained in the text; with ``longest`` not all of the shorter ones.

    Up to ``few`` words are broadcast and looked for one by one. Of more of them, those in texts of up to
    SHORT characters are found by an equality join on all pieces of a text, at most SHORT * SHORT / 2
    and only as long as words are, which grows with the texts and not with the words. Longer texts go
    through automata over all words at once (:func:`containment.contained`), whose pairs are joined by equality.
    """
    known = _sizes(words, word)
    if known.n <= few:
        return texts.join(F.broadcast(words), F.col(text).contains(F.col(word)))
    short = texts.filter(F.length(text).between(known.least, SHORT)).withColumn("_piece", F.explode(_pieces(text, known.least, known.most)))
    found, rest = short.join(_sent(words, known.bytes), F.col("_piece") == F.col(word)).drop("_piece"), texts.filter(F.length(text) > SHORT)
    if rest.isEmpty():
        return found
    pairs = containment.contained(rest, text, words, word, longest)
    return found.unionByName(rest.join(pairs.join(_sent(words, known.bytes), word).hint("merge"), text))


def _placed(words: DataFrame, *order: Column) -> DataFrame:
    """Words with ``_place`` for ``_o``, which rises in the order given: of many rows a number is compared and kept faster than what it stands for."""
    return stored(words.orderBy(*order).drop("_o").withColumn("_place", F.monotonically_increasing_id()), "placed")


def longest_contained(df: DataFrame, text: str, dim: DataFrame, word: str, result: str, least: int = 1, few: int = FEW) -> DataFrame:
    """``match``: ``result`` of the entry of ``dim`` that equals ``text``, else of the longest contained in it.

    Ties go to the lower ``ord``. Two phases: an equi join finds equal entries; only distinct texts
    that have none are searched for contained ones (:func:`containing`). A null text has no match.
    """
    words = dim.select(F.col(word).alias("_w"), F.col("ord").alias("_o"), F.col(result).alias("_r")).filter(F.length("_w") > 0)
    many = words.limit(few + 1).count() > few
    if many:
        words = _placed(words, -F.length("_w"), F.col("_o"))
        equal = words.groupBy(F.col("_w").alias(text)).agg(F.min("_place").alias("_equal")).hint("merge")
    else:
        equal = F.broadcast(words.groupBy(F.col("_w").alias(text)).agg(F.min_by("_r", "_o").alias("_equal")))
    texts = df.select(text).distinct().join(equal, text, "left")
    rest, long = texts.filter("_equal is null").select(text), words.filter(F.length("_w") >= least)
    if many:
        inside = containing(rest, text, long.select("_w", "_place"), "_w", few, longest=True).groupBy(text).agg(F.min("_place").alias("_inside")).hint("merge")
        found = texts.join(inside, text, "left").select(F.col(text).alias("_t"), F.coalesce("_equal", "_inside").alias("_place"))
        found = found.join(words.select("_place", F.col("_r").alias("match")).hint("merge"), "_place").select("_t", "match").hint("merge")
    else:
        inside = containing(rest, text, long, "_w", few, longest=True)
        inside = inside.groupBy(text).agg(F.min_by("_r", F.struct(-F.length("_w"), "_o")).alias("_inside"))
        found = texts.join(inside, text, "left").select(F.col(text).alias("_t"), F.coalesce("_equal", "_inside").alias("match"))
    return df.join(found, F.col(text).eqNullSafe(F.col("_t")), "left").drop("_t")


def resolve_alias(df: DataFrame, name: str, aliases: DataFrame, result: str, least: int = 5, few: int = FEW) -> DataFrame:
    """``match``: by equal alias, else the first alias of ``least`` or more characters that contains the name or is contained in it."""
    words = aliases.select(F.col("alias").alias("_a"), F.col("ord").alias("_o"), F.col(result).alias("_r"))
    names = df.select(name).distinct().filter(F.length(name) > 0)
    if words.limit(few + 1).count() > few:
        found = _first_aliases(names.select(F.col(name).alias("_t")), words, least, few).hint("merge")
    else:
        long = words.filter(F.length("_a") >= least)
        same = names.join(F.broadcast(words), F.col(name) == F.col("_a"))
        inner = containing(names, name, long, "_a", few)
        outer = containing(long, "_a", names, name, few)
        every = same.unionByName(inner.select(same.columns)).unionByName(outer.select(same.columns))
        found = every.groupBy(F.col(name).alias("_t")).agg(F.min_by("_r", F.struct((F.col(name) != F.col("_a")).alias("near"), "_o")).alias("match"))
    return df.join(found, F.col(name) == F.col("_t"), "left").drop("_t")


def _first_aliases(names: DataFrame, words: DataFrame, least: int, few: int) -> DataFrame:
    """For names (_t) the ``match`` of :func:`resolve_alias` among many words (_a, _o, _r).

    A name is a piece of an alias if it begins one of the alias's ends. So each distinct end of aliases
    keeps the first alias that has it, then each distinct beginning of those ends the first of theirs:
    a name finds its own there, however many aliases contain it.
    """
    words = _placed(words, F.col("_o"))
    places, known = words.select("_a", "_place"), _sizes(names, "_t")
    long, place = places.filter(F.length("_a") >= least), lambda c: F.col("_place").alias(c)
    none = lambda c: F.lit(None).cast("long").alias(c)
    ends = long.filter(F.length("_a").between(known.least, SHORT)).select(F.explode(_suffixes(F.col("_a"), known.least)).alias("_end"), "_place")
    ends = ends.groupBy("_end").agg(F.min("_place").alias("_place"))
    around = ends.select(F.explode(_prefixes(F.col("_end"), known.least, known.most)).alias("_t"), none("_equal"), place("_near"), F.lit(False).alias("_named"))
    same = places.select(F.col("_a").alias("_t"), place("_equal"), none("_near"), F.lit(False).alias("_named"))
    asked = names.select("_t", none("_equal"), none("_near"), F.lit(True).alias("_named"))
    met = around.unionByName(same).unionByName(asked).groupBy("_t").agg(F.min("_equal").alias("_equal"), F.min("_near").alias("_near"), F.max("_named").alias("_named"))
    met = met.filter("_named").drop("_named")
    inner = containing(names, "_t", long, "_a", few).select("_t", none("_equal"), place("_near"))
    met = met.unionByName(inner)
    rest = long.filter(F.length("_a") > SHORT)
    if not rest.isEmpty():
        pairs = containment.contained(rest, "_a", names, "_t")
        met = met.unionByName(pairs.join(rest.hint("merge"), "_a").select("_t", none("_equal"), place("_near")))
    first = met.groupBy("_t").agg(F.coalesce(F.min("_equal"), F.min("_near")).alias("_place"))
    return first.join(words.select("_place", F.col("_r").alias("match")).hint("merge"), "_place").select("_t", "match")


def shared_tokens(left: DataFrame, right: DataFrame, block: str, tokens: str, least: int) -> DataFrame:
    """Pairs of rows with an equal ``block`` and ``least`` or more common tokens; columns get the suffixes _a and _b.

    In any one order of tokens, two rows that share ``least`` of them share one among the first
    size - least + 1 of each; so rows meet by block and such a token, long (rare) tokens first, and a
    pair counts at the first token that it shares there.
    """

    def prefixed(df: DataFrame, side: str) -> DataFrame:
        ordered = F.array_sort(F.transform(F.array_distinct(tokens), lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t"))))
        first = F.slice(F.transform(ordered, lambda x: x["t"]), 1, F.greatest(F.size(ordered) - least + 1, F.lit(0)))
        out = df.select(*(F.col(c).alias(f"{c}_{side}") for c in df.columns), F.col(block).alias("_block"), first.alias(f"_first_{side}"))
        return out.withColumn("_token", F.explode(f"_first_{side}"))

    met = prefixed(left, "a").join(prefixed(right, "b"), ["_block", "_token"])
    met = met.filter(F.col("_token") == F.array_intersect("_first_a", "_first_b")[0]).withColumn("common", F.size(F.array_intersect(f"{tokens}_a", f"{tokens}_b")))
    return met.filter(F.col("common") >= least).drop("_block", "_token", "_first_a", "_first_b")


def fuzzy_person(people: DataFrame, known: DataFrame, least: int = 3) -> DataFrame:
    """``match_id``: the smallest id of a known person with the same document, else the same given name and ``least`` shared name tokens.

    people: name, doc; known: id, name, doc. Candidates are blocked on the given name.
    """
    named = people.select("name", "doc").distinct().withColumn("given", given_name(F.col("name"))).withColumn("tokens", name_tokens(F.col("name")))
    listed = known.withColumn("given", given_name(F.col("name"))).withColumn("tokens", F.array_sort(name_tokens(F.col("name"))))
    listed = listed.filter("given <> ''").groupBy("given", "tokens").agg(F.min("id").alias("id"))  # those of one name match alike, so the first of them stands for all
    by_doc = known.filter("doc <> ''").groupBy("doc").agg(F.min("id").alias("doc_id"))
    pairs = shared_tokens(named.filter("given <> ''"), listed.select("id", "given", "tokens"), "given", "tokens", least)
    by_name = pairs.groupBy(F.col("name_a").alias("name"), F.col("doc_a").alias("doc")).agg(F.min("id_b").alias("name_id"))
    found = named.join(by_doc, "doc", "left").join(by_name, ["name", "doc"], "left").select("name", "doc", F.coalesce("doc_id", "name_id").alias("match_id"))
    return people.join(found, ["name", "doc"], "left")


def lookup(ids: DataFrame, key: str, *sources: DataFrame) -> DataFrame:
    """Smallest ``id`` of any of the sources (key, id) for each key: an OR of lookups as a union and one equi join."""
    everything = sources[0]
    for s in sources[1:]:
        everything = everything.unionByName(s)
    return ids.join(everything.groupBy(key).agg(F.min("id").alias("id")), key, "left")


def pairs_within(df: DataFrame, group: str, pos: str, keep: list[str]) -> DataFrame:
    """Ordered pairs of rows of a group, earlier before later; for groups that are small by nature, such as a person's medicines."""
    a = df.select(group, *(F.col(c).alias(f"{c}_a") for c in (pos, *keep)))
    b = df.select(group, *(F.col(c).alias(f"{c}_b") for c in (pos, *keep)))
    return a.join(b, group).filter(F.col(f"{pos}_a") < F.col(f"{pos}_b"))


def overlay(base: DataFrame, extra: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with the non-null values of ``extra`` for ``columns`` in their place, and the rows that only ``extra`` has."""
    b = base.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return b.join(extra, key, "full").select(key, *(F.coalesce(c, f"_{c}").alias(c) for c in columns))
