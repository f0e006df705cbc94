"""A training-corpus pipeline: toxic documents, near copies and benchmark leaks go, sources are mixed, tokens are written.

Every stage takes (spark, docs, sf_dir) and works on all of ``docs``; all but the last return the
columns of ``documents``. Each row is a document of its own, whatever its doc_id, which may be null or
repeat: stages number the rows and decide by number. Only labels belong to doc_ids. An empty table passes
through. Columns beyond those of ``documents`` are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.llm.common import driver_gives_back, fresh, numbered, quoted, shared_dir
from serieslab.llm.decontaminate import decontaminate
from serieslab.llm.mix import mix
from serieslab.llm.near_dedup import near_dedup
from serieslab.llm.tokens import token_output, with_crc
from serieslab.llm.toxicity import toxicity


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of each row, and the name of its column, which no other column has; what the driver held for the stage before goes first."""
    driver_gives_back(docs.sparkSession)
    row = fresh("row_", docs)
    return numbered(docs, row), row


def _without(docs: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """Numbered ``docs`` but for the rows of ``gone``."""
    return docs.join(gone.select(F.col("row").alias(row)), row, "left_anti").drop(row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; the model learns from the labelled ones among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    docs, row = _numbered(docs)
    return _without(docs, row, toxicity(docs, labels, holdout=None, row=row).filter("predicted = 1"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (5-word shingles, similarity 0.8): the first by doc_id."""
    docs, row = _numbered(docs)
    return _without(docs, row, near_dedup(docs, k=5, threshold=0.8, row=row).filter("not kept"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words of a benchmark item, or a whole shorter item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs, row = _numbered(docs)
    return _without(docs, row, decontaminate(docs, benchmark, span=10, row=row).filter("n_hit > 0"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: up to three times, or not at all."""
    columns, (docs, row), times = list(map(quoted, docs.columns)), _numbered(docs), fresh("times_", docs)
    copies = mix(docs, members="source", weights=(1.0, 2.0, 3.0), most=3, row=row).filter("copies > 0")
    taken = docs.join(copies.select(F.col("row").alias(row), F.col("copies").cast("int").alias(times)), row)
    return taken.select(*columns, F.explode(F.sequence(F.lit(1), times)).alias(fresh("time_", docs))).select(columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in doc_id order, read back: doc_id, start, n_tokens and a checksum of the ids."""
    driver_gives_back(spark)
    return with_crc(token_output(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Stages with learnt models and sketches can't be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
