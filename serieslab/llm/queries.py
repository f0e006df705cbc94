"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.llm import spelling, turns, warc
from serieslab.llm.common import shared_dir
from serieslab.llm.decontaminate import decontaminate
from serieslab.llm.exact_dedup import exact_dedup
from serieslab.llm.language import identify
from serieslab.llm.line_dedup import line_dedup
from serieslab.llm.lm import lm_score
from serieslab.llm.mix import mix
from serieslab.llm.near_dedup import near_dedup
from serieslab.llm.piece_codec import encode_pieces
from serieslab.llm.tokens import token_output, with_crc
from serieslab.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=10)
    ids = F.array_join("items", ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), holdout=(10, 0))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), k=4, threshold=0.8).drop("row")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), weights=(1.0, 2.0, 3.0), most=3)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "archive")
    pages = table(spark, sf_dir, "pages")
    warc.archive(pages, path)
    return warc.resolved(warc.read_warc(warc.keys_of(pages), f"{path}/index", f"{path}/warc"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), holdout=(4, 2)).drop("shares")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_crc(token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("row")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity(table(spark, sf_dir, "documents"), labels, holdout=(5, 0))


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation, after damage by the hash of where its turns stand."""
    conversations = table(spark, sf_dir, "conversations")
    repaired, report = turns.repair(turns.damage(conversations))
    return turns.whole_report(conversations, repaired, report)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some of which lose a letter by the hash of where they stand, with the forms that they are variants of."""
    runs = spelling.one_letter_lost(spelling.occurrences(table(spark, sf_dir, "documents"), least_chars=5), every=97)
    return spelling.spelling_groups(spelling.vocabulary(runs, least=3, least_chars=5), ratio=2)


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by the agenda of pairs, held against the library in each batch, and what they decode to."""
    out = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), check=True)
    ids = F.array_join(F.col("tokens").cast("array<string>"), ",")
    return out.select("doc_id", "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
