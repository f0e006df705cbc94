"""The medicine catalogue: grouping a registry, merging lists into it, searching it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieslab.functions.numbers import STRENGTH, strength_labels
from serieslab.functions.text import norm_text
from serieslab.operators import joins
from serieslab.session import stored

# Words for salts before and after an active principle, and words of forms in brand names.
SALT_BEFORE = ("cloridrato", "clorhidrato", "sulfato", "maleato", "besilato", "acetato", "fumarato", "tartarato", "tartrato", "succinato", "mesilato", "fosfato", "bromidrato", "bromhidrato", "nitrato", "citrato", "sodico", "potassico", "calcico", "hemifumarato", "dicloridrato", "valerato", "propionato", "pamoato", "estolato")
SALT_AFTER = ("sodica", "sódica", "sodico", "sódico", "potassica", "potássica", "potassico", "potássico", "calcica", "cálcica", "dihidratado", "monohidratado", "anhidro", "trihidratado")
FORMS = ("comprimidos?", "comp", "capsulas?", "c[aá]psulas?", "caps", "tabletas?", "drageas?", "grageas?", "solucao", "soluç[aã]o", "solucion", "soluci[oó]n", "injetavel", "inyectable", "iny", "xarope", "jarabe", "suspensao", "suspensi[oó]n", "creme", "crema", "gel", "pomada", "revestidos?", "recubiertos?", "pelicula", "pel[ií]cula", "liberacao", "liberaci[oó]n", "prolongada", "oral", "subcutanea", "subcut[aá]nea", "reditabs?", "md", "forte", "xr", "sr")
#: Entries listed of a generic at most.
MOST_BRANDS, MOST_STRENGTHS = 50, 24


def base_principle(generic: Column) -> Column:
    """An active principle without its salt; empty for combinations."""
    g = F.trim(generic)
    bare = F.regexp_replace(g, rf"(?i)^({'|'.join(SALT_BEFORE)})\s+de\s+", "")
    bare = F.regexp_replace(bare, rf"(?iu)\s+({'|'.join(SALT_AFTER)})$", "")
    return F.when(g.contains(",") | g.contains(" + ") | g.rlike(r"\se\s"), F.lit("")).otherwise(F.trim(bare))


def brand_name(product: Column) -> Column:
    """A product name without strengths, lone numbers, words of forms and trade mark signs."""
    b = F.regexp_replace(product, STRENGTH, " ")
    b = F.regexp_replace(b, r"\b\d+(?:[.,]\d+)?\b", " ")
    b = F.regexp_replace(b, rf"(?iuU)\b({'|'.join(FORMS)})\b", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(b, "[®™]", " "), r"\s+", " "), F.lit(" .-·,"))


def group_products(products: DataFrame, corrected: bool = False) -> DataFrame:
    """A registry (ord, product, generic) as catalogue entries by normalised active principle.

    The first product seen gives an entry its name; brands are distinct, sorted without regard to case,
    and at most MOST_BRANDS; strengths are distinct, sorted, at most MOST_STRENGTHS. Principles of under
    three letters are left out.
    """
    rows = products.select("ord", "generic", "product", F.coalesce(F.nullif(base_principle(F.col("generic")), F.lit("")), "generic").alias("base"))
    rows = rows.withColumn("key", norm_text(F.col("base"))).filter(F.length("key") >= 3)
    brands = F.collect_set(brand_name(F.col("product")))
    dosed = F.array_distinct(F.flatten(F.collect_set(strength_labels(F.col("product")))))
    out = rows.groupBy("key").agg(F.min_by("base", "ord").alias("generic"), brands.alias("brands"), dosed.alias("strengths"))
    by_case = F.transform(F.array_sort(F.transform("brands", lambda b: F.struct(F.lower(b).alias("l"), b.alias("b")))), lambda x: x["b"])
    value = lambda s: F.struct(F.substring_index(s, " ", -1).alias("u"), F.translate(F.split_part(F.split_part(s, F.lit(" "), F.lit(1)), F.lit("/"), F.lit(1)), ",", ".").try_cast("double").alias("v"), s.alias("s"))
    by_value = F.transform(F.array_sort(F.transform("strengths", value)), lambda x: x["s"])
    return out.select("key", "generic", F.array(F.col("key")).alias("aliases"), F.slice(by_case, 1, MOST_BRANDS).alias("brands"), F.slice(by_value, 1, MOST_STRENGTHS).alias("strengths"))


def merge_overlay(catalog: DataFrame, extra: DataFrame) -> DataFrame:
    """``catalog`` with entries of ``extra`` (key, generic, aliases, brands, strengths) fused into it.

    An extra entry goes to the entry that has its first known alias, else that of its key, else it is
    new. Aliases and brands are united; its strengths, where it has any, take the place of parsed ones.
    """
    known = catalog.select(F.col("key").alias("_target"), F.explode("aliases").alias("alias"))
    tries = F.concat("aliases", F.array("key", norm_text(F.col("generic"))))
    wanted = extra.select("key", F.posexplode(tries).alias("pos", "alias")).join(known, "alias").groupBy("key").agg(F.min_by("_target", "pos").alias("_target"))
    placed = extra.join(wanted, "key", "left").withColumn("key", F.coalesce("_target", "key")).drop("_target")
    e = placed.groupBy("key").agg(F.first("generic").alias("g2"), F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("a2"), F.array_distinct(F.flatten(F.collect_list("brands"))).alias("b2"), F.array_distinct(F.flatten(F.collect_list("strengths"))).alias("s2"))
    both = catalog.join(e, "key", "full")
    none = F.array().cast("array<string>")
    union = lambda a, b: F.array_union(F.coalesce(a, none), F.coalesce(b, none))
    return both.select("key", F.coalesce("generic", "g2").alias("generic"), union("aliases", "a2").alias("aliases"), union("brands", "b2").alias("brands"), F.when(F.size("s2") > 0, F.col("s2")).otherwise(F.coalesce("strengths", none)).alias("strengths"))


def match_products(products: DataFrame, catalog: DataFrame) -> DataFrame:
    """``match``: the catalogue key that a product's normalised name equals, else the longest that it contains; of equal ones the first by a checksum of the key."""
    dim = catalog.select(F.crc32(F.col("key").cast("binary")).alias("ord"), norm_text(F.col("generic")).alias("word"), F.col("key").alias("entry")).filter(F.length("word") >= 3)
    return joins.longest_contained(products.withColumn("norm", norm_text(F.col("product"))), "norm", dim, "word", "entry")


def search(catalog: DataFrame, query: str, most: int = 12) -> DataFrame:
    """The first ``most`` entries for a query of two or more characters.

    Tiers: equal name, name prefix, alias prefix, brand prefix, contained anywhere; entries without
    strengths after all others, then tier, then name. ``matched_brand`` is the first brand that contains
    the query.
    """
    q = re.sub(" +", " ", query.strip().lower())
    name, prefix = norm_text(F.col("generic")), lambda c: F.exists(c, lambda x: norm_text(x).startswith(q))
    inside = lambda c: F.exists(c, lambda x: norm_text(x).contains(q))
    tier = F.when(name == q, 0).when(name.startswith(q), 1).when(prefix("aliases"), 2).when(prefix("brands"), 3).otherwise(4)
    hits = catalog.filter(F.lit(len(q) >= 2) & (name.contains(q) | inside("aliases") | inside("brands")))
    undosed = (F.size("strengths") == 0).cast("int")
    brand = F.get(F.filter("brands", lambda x: norm_text(x).contains(q)), 0)
    out = hits.select("key", "generic", "strengths", brand.alias("matched_brand"), tier.alias("tier"), undosed.alias("undosed"), name.alias("_name"))
    return out.orderBy("undosed", "tier", "_name", "key").limit(most).drop("_name")


def search_many(catalog: DataFrame, queries: DataFrame, most: int = 12) -> DataFrame:
    """:func:`search` for any number of queries (query_id, query) in one job: query_id, place, key, generic, strengths, matched_brand, tier, undosed.

    Names, aliases and brands are cut into their distinct pieces of two and three letters. A query meets the
    entries by its rarest piece alone, whose entries are the fewest of those that can contain
    it; then it is looked for in them. Queries under two letters have no results; equal queries are searched
    once. The first ``most`` are chosen with a limit in each task before the shuffle.
    """
    pieces = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(0))), lambda i: F.substr(c, i, F.lit(n)))
    listed = lambda kind, c: F.transform(c, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x.alias("shown"), norm_text(x).alias("text")))
    texts = catalog.select("key", F.inline(F.concat(listed(0, F.array("generic")), listed(1, F.col("aliases")), listed(2, F.col("brands"))))).filter("length(text) > 1")
    grams = F.array_distinct(F.concat(*(F.when(F.length("text") >= n, pieces(F.col("text"), n)).otherwise(F.array().cast("array<string>")) for n in (2, 3))))
    postings = stored(texts.select("key", "kind", "i", "shown", "text", F.explode(grams).alias("gram")), "postings")
    asked = queries.select("query_id", F.lower(F.trim(F.regexp_replace("query", " +", " "))).alias("q")).filter("length(q) > 1")
    n = F.least(F.lit(3), F.length("q"))
    own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("q") - n + 1), lambda i: F.substr(F.col("q"), i, n)))
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a piece that no entry has makes the query one without results, so it is the rarest of all
    rarest = asked.select("q").distinct().select("q", F.explode(own).alias("gram")).join(counts, "gram", "left").groupBy("q").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    hits = postings.join(stored(rarest, "rarest"), "gram").filter(F.col("text").contains(F.col("q")))
    starts = F.col("text").startswith(F.col("q"))
    tier = F.when((F.col("kind") == 0) & (F.col("text") == F.col("q")), 0).when(starts, F.col("kind") + 1).otherwise(4)
    found = hits.groupBy("q", "key").agg(F.min(tier).alias("tier"), F.min_by("shown", F.when(F.col("kind") == 2, F.col("i"))).alias("matched_brand"))
    found = found.join(catalog.select("key", "generic", "strengths"), "key").withColumn("undosed", (F.size("strengths") == 0).cast("int"))
    order = Window.partitionBy("q").orderBy("undosed", "tier", norm_text(F.col("generic")), "key")
    best = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    return asked.join(best, "q").select("query_id", "place", "key", "generic", "strengths", "matched_brand", "tier", "undosed")


def statistics(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("strengths") > 0).alias("n_dosed"), F.coalesce(F.sum(F.size("brands")), F.lit(0)).cast("long").alias("n_brands"))
