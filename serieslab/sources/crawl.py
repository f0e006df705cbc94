"""A paged crawl as a Spark data source: one partition a page."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Tries of a page, and seconds that the wait grows by after each.
TRIES, BACK_OFF = 3, 1.0


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.url, self.pages = options["url"], int(options.get("pages", 300))
        self.first, self.timeout = int(options.get("first", 1)), float(options.get("timeout", 60))
        self.back_off = float(options.get("backOff", BACK_OFF))

    def partitions(self) -> list[Page]:
        return [Page(self.first + i) for i in range(self.pages)]

    def read(self, partition: Page) -> Iterator[tuple]:
        """One row: the page's text, or after all tries the error instead."""
        url, error = self.url.format(page=partition.number), None
        for attempt in range(1, TRIES + 1):
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as answer:  # noqa: S310
                    yield (partition.number, url, answer.read().decode("utf-8", "replace"), None)
                return
            except OSError as e:
                error = f"{type(e).__name__}: {e}"
                if attempt < TRIES:
                    time.sleep(self.back_off * attempt)
        yield (partition.number, url, None, error)


class PagedSource(DataSource):
    """``spark.read.format("paged").option("url", "https://.../{page}").option("pages", 300)``"""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, url string, html string, error string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)


def crawl(spark: SparkSession, url: str, path: str, empty: Column, most: int = 300, wave: int = 50, **options: str) -> DataFrame:
    """The pages before the first ``empty`` one (a condition on ``html``), at most ``most``; failed pages have an ``error``.

    Pages are fetched in waves of ``wave`` in parallel and appended to the table at ``path``; a wave with
    an empty page is the last. A page that fails is no end: it is reported, and later ones are fetched.
    """
    end = None
    for first in range(1, most + 1, wave):
        source = spark.read.format("paged").options(url=url, first=first, pages=min(wave, most + 1 - first), **options)
        source.load().write.mode("append").parquet(path)
        end = spark.read.parquet(path).filter((F.col("page") >= first) & F.col("error").isNull() & empty).agg(F.min("page")).first()[0]
        if end is not None:
            break
    pages = spark.read.parquet(path)
    return pages if end is None else pages.filter(F.col("page") < end)
