"""Laboratory pages as words with places: lines, columns, and rows of results.

Bands and row rules of a layout are data; one function serves all layouts that are tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.operators import series

# Layout, line tolerance, and the right ends of its columns name, result, unit and method.
BANDS = """
verdejo 1.5 200 290 335 450
brunelli 1.5 140 258 310 450
sanisidro 2.0 185 310 440 100000
"""


def bands(layout: str) -> tuple[float, list[float]]:
    row = next(line.split() for line in BANDS.strip().splitlines() if line.startswith(layout))
    return float(row[1]), [float(x) for x in row[2:]]


def pages_of(words: DataFrame) -> DataFrame:
    """words (doc, page, x, y, word) as one row a page: doc, page and words, from the top; a page holds few words."""
    down = F.sort_array(F.collect_list(F.struct(F.col("y").isNull().alias("lost"), "y", "x", "word")))
    return words.groupBy("doc", "page").agg(F.transform(down, lambda w: F.struct(w["x"].alias("x"), w["word"].alias("word"), w["y"].alias("y"))).alias("words"))


def lined(pages: DataFrame, tolerance: float) -> DataFrame:
    """Pages (of :func:`pages_of`): doc, page and lines, an array of the words of each line; all words of a page in their order.

    A word joins the first line of its page within ``tolerance``. The rule is greedy and goes down the page. Heights
    of lines rise by more than the tolerance, so a word can only join the last one. A word without a height is a line
    of its own, below all others. Pages are read in batches and nothing is shuffled.
    """

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(2).flatten()
            heights, sizes = words.field(2).to_pylist(), batch.column(2).value_lengths().to_pylist()
            firsts, begins, at = [], [], 0
            for size in sizes:
                top = None
                firsts.append(len(begins))
                for k in range(at, at + size):
                    y = heights[k]
                    if top is None or y is None or not y - top <= tolerance:
                        top = y
                        begins.append(k)
                at += size
            of_words = pa.ListArray.from_arrays(pa.array([*begins, at], pa.int32()), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array([*firsts, len(begins)], pa.int32()), of_words)], ["doc", "page", "lines"])

    return pages.select("doc", "page", "words").mapInArrow(cluster, "doc string, page int, lines array<array<struct<x:double,word:string,y:double>>>")


def gathered(pages: DataFrame, tolerance: float) -> DataFrame:
    """Lines of pages (of :func:`pages_of`, or words) as :func:`lined` finds them: doc, page, line, y (the least of the line) and w, its words from the left."""
    if "words" not in pages.columns:
        pages = pages_of(pages)
    found = lined(pages, tolerance).select("doc", "page", F.posexplode("lines").alias("line", "w"))
    return found.select("doc", "page", F.col("line").cast("long").alias("line"), F.get("w", F.lit(0))["y"].alias("y"), F.sort_array("w").alias("w"))


def lines(words: DataFrame, tolerance: float) -> DataFrame:
    """words (doc, page, x, y, word) with ``line``, the number of their line on the page (:func:`gathered`)."""
    return gathered(words, tolerance).select("doc", "page", "line", F.inline("w")).select("doc", "page", "x", "y", "word", "line")


def said(w: Column) -> Column:
    """The text of a line."""
    return F.array_join(F.transform(w, lambda v: v["word"]), " ")


def column_of(x: Column, ends: list[float]) -> Column:
    name, result, unit, method = ends
    return F.when(x < name, "name").when(x < result, "result").when(x < unit, "unit").when(x < method, "method").otherwise("reference")


COLUMNS = ("name", "result", "unit", "method", "reference")


def cells(lined: DataFrame, ends: list[float]) -> DataFrame:
    """Lines (of :func:`gathered`) with the text of their columns, empty where a column has no words."""
    of = lambda c: said(F.filter("w", lambda v: column_of(v["x"], ends) == c)).alias(c)
    return lined.select("*", *(of(c) for c in COLUMNS))


def table_rows(lined: DataFrame, ends: list[float]) -> DataFrame:
    """One row for each line of words (doc, page, line, x, word) with the text of its columns, blanks where a column has no words."""
    rows = lined.groupBy("doc", "page", "line").agg(F.sort_array(F.collect_list(F.struct("x", "word"))).alias("w"))
    return cells(rows, ends).drop("w")


def result_rows(words: DataFrame, layout: str, section: str = r"^[A-ZÁÉÍÓÚÑ ]{4,}$") -> DataFrame:
    """Results of a tabular layout: section headings carried down, lines without a name added to the row above."""
    tolerance, ends = bands(layout)
    rows = cells(gathered(words, tolerance), ends).withColumn("place", F.col("page") * 100000 + F.col("line"))
    heading = (F.col("result") == "") & F.col("name").rlike(section) & (F.size(F.split("name", " ")) <= 4)
    rows = series.carry_forward(rows, "doc", ["place"], F.when(heading, F.col("name")), "section")
    rows = series.blocks(rows.filter(~heading), "doc", ["place"], F.col("name") != "")
    join = lambda c: F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", c))), lambda x: x[c]), " ")).alias(c)
    out = rows.filter("block > 0").groupBy("doc", "block").agg(F.first("section").alias("section"), join("name"), join("result"), join("unit"), join("method"), join("reference"))
    return out.filter("result <> ''")


def text_blocks(texts: DataFrame, doc: str, text: str, header: Column) -> DataFrame:
    """Lines of texts with block numbers: a line for which ``header`` (over ``line`` and ``next``) holds starts one."""
    rows = texts.select(doc, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    rows = rows.withColumn("next", series.next_line(doc, ["pos"], F.col("line"))).withColumn("prev", series.previous_line(doc, ["pos"], F.col("line")))
    return series.blocks(rows, doc, ["pos"], F.coalesce(header, F.lit(False)))
