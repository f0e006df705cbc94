"""Token-ID output: Parquet list columns with controlled encodings, row groups and page indexes."""

from __future__ import annotations

import functools
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from serieslab.llm.common import arrow_map, shared_dir
from serieslab.llm.words import pieces, together

#: Distinct words whose ids a task keeps.
REMEMBERED = 300_000
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
#: Bytes of text that are encoded together.
TOGETHER = 4 << 20
#: The character that byte-level tokenizers write for each byte: itself if printable, else one from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: b for b in _PRINTABLE} | {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


def ragged(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[b : b + n] for each b and n, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class WordEncoder:
    """Ids of texts by a tokenizer that never joins across blanks: it encodes each distinct word once.

    The tokenizer drops white space, lower-cases, and splits words from punctuation before its merges,
    so the ids of a text are those of its blank-separated pieces one after another, and the ids of a
    piece that ends in ASCII punctuation after a letter or digit are those of both parts. Pieces that may
    hold the text of a special token stay as they are. Tested against whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, int] = {"": 0}
        self.ids, self.starts, self.again = np.zeros(0, np.uint32), np.zeros(2, np.int64), np.ones(1, bool)

    def learn(self, words: list[str]) -> None:
        """Encode those of the words that are not known yet. When too many are known, those met once go."""
        new = list(set(words).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            keep = np.flatnonzero(self.again)[: REMEMBERED // 2]
            names, sizes = list(self.known), np.diff(self.starts)[keep]
            self.ids, self.starts = ragged(self.ids, self.starts[keep], sizes), np.concatenate([[0], np.cumsum(sizes)])
            self.known, self.again = {names[i]: j for j, i in enumerate(keep)}, np.arange(len(keep)) == 0
            new = list(set(words).difference(self.known))
        coded: list[list[int]] = []
        for i in range(0, len(new), 2000):
            part = new[i : i + 2000]
            # nothing to normalise or split in lower-case letters: the tokenizer's model can have their bytes
            plain = [w.isalpha() and w.islower() and w == w.lower() and unicodedata.is_normalized("NFC", w) for w in part]
            rest = iter(self.tokenizer.encode_batch_fast([w for w, p in zip(part, plain, strict=True) if not p], add_special_tokens=False))
            merge = self.tokenizer.model.tokenize
            coded += [[t.id for t in merge(w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_CHARS))] if p else next(rest).ids for w, p in zip(part, plain, strict=True)]
        base = len(self.known)
        self.known.update((w, base + j) for j, w in enumerate(new))
        self.ids = np.concatenate([self.ids, np.fromiter((x for c in coded for x in c), np.uint32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))])
        self.again = np.concatenate([self.again, np.zeros(len(new), bool)])

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    @staticmethod
    def tails(low: pa.Array, core: pa.Array, cut: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Distinct punctuation that was cut off, and which of it each of the pieces ``cut`` had."""
        size = (pc.binary_length(low).to_numpy(zero_copy_only=False) - pc.binary_length(core).to_numpy(zero_copy_only=False))[cut]
        ends = np.frombuffer(low.buffers()[1], np.int32, len(low) + 1, low.offset * 4)[1:][cut]
        data = np.frombuffer(low.buffers()[2] or b"", np.uint8)
        packed = np.zeros(len(cut), np.uint64)
        for j in range(8):  # the last 8 bytes; longer tails are made distinct by their piece
            more = np.flatnonzero(size > j)
            packed[more] |= data[ends[more] - 1 - j].astype(np.uint64) << np.uint64(8 * j)
        packed[size > 8] = np.flatnonzero(size > 8).astype(np.uint64) | np.uint64(1 << 63)  # no ASCII byte sets that bit
        _, first, tail = np.unique(packed, return_index=True, return_inverse=True)
        return [data[ends[i] - size[i] : ends[i]].tobytes().decode() for i in first], tail

    def of_pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the distinct pieces one after another, number of ids of each)."""
        special = pc.match_substring(distinct, "<|")
        low = pc.if_else(special, distinct, pc.ascii_lower(distinct))
        core = pc.utf8_rtrim(low, characters=PUNCTUATION)
        core = pc.if_else(pc.and_not(pc.match_substring_regex(core, r"[\p{L}\p{N}]$"), special), core, low)
        cut = np.flatnonzero(pc.not_equal(pc.binary_length(core), pc.binary_length(low)).to_numpy(zero_copy_only=False))
        tails, tail = self.tails(low, core, cut)
        core = core.dictionary_encode()
        cores = core.dictionary.to_pylist()
        before = len(self.again)
        self.learn(cores + tails)
        parts = np.zeros((len(low), 2), np.int64)
        parts[:, 0] = self.numbers(cores)[core.indices.to_numpy()]
        parts[cut, 1] = self.numbers(tails)[tail]
        met = parts[parts < before] if len(self.again) >= before else parts.ravel()
        self.again[met] = True
        sizes = np.diff(self.starts)[parts]
        return ragged(self.ids, self.starts[parts].ravel(), sizes.ravel()), sizes.sum(axis=1)

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text); ``end`` closes each text."""
        word, distinct, offsets = pieces(texts)
        own, per_word = self.of_pieces(distinct)
        out = ragged(own, (np.cumsum(per_word) - per_word)[word], per_word[word])
        per_text = np.diff(np.concatenate([[0], np.cumsum(per_word[word])])[offsets])
        if end is not None:
            out = np.insert(out, np.cumsum(per_text), end)
            per_text = per_text + 1
        return out, per_text


@functools.lru_cache(1)
def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process; what it has learnt serves its later tasks too."""
    return WordEncoder(path)


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int | None = 2, row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10) -> None:
    """Encode every text of ``docs`` and write the ids to ``path`` in ascending doc_id order.

    Each file holds one range of doc_ids, sorted: columns part, doc_id, local_start (ids before the
    document in this file), n_tokens and ids (list of int). Ids and parts are dictionary encoded,
    doc_id and the counts delta encoded (Parquet v2 pages); row groups and pages have the given sizes,
    and Spark's writer adds column and offset indexes, so readers fetch counts or some documents
    without the other pages. A null text counts as empty; rows with one doc_id are ordered by a hash of
    their text, null doc_ids come first; other columns are not read.

    Texts are shuffled once, by range; tasks then stream over sorted rows.
    """

    def encode() -> callable:
        from pyspark import TaskContext

        coder, part, before = encoder(tokenizer_path), TaskContext.get().partitionId(), 0

        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal before
            coded = [coder.encode(part, end_id) for _, part in together(pc.fill_null(batch.column(1), ""), TOGETHER)]
            ids, counts = (np.concatenate(x) for x in zip(*coded, strict=True))
            ends = np.cumsum(counts)
            starts, before = before + ends - counts, before + int(ends[-1])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), part, np.int32)), batch.column(0), pa.array(starts), pa.array(counts), lists], ["part", "doc_id", "local_start", "n_tokens", "ids"])

        return of

    tie = F.xxhash64("text")
    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    coded = arrow_map(ranged.select("doc_id", "text"), encode, "part int, doc_id long, local_start long, n_tokens long, ids array<int>")
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#ids.list.element": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#local_start": "false", "parquet.enable.dictionary#n_tokens": "false", "parquet.page.size.row.check.min": 10, "compression": "zstd"}
    coded.write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of files by :func:`write_tokens`.

    Each file's place in the whole order follows from its number of ids, summed over the files (one
    row a file); reads that leave out ``ids`` touch no page of it.
    """
    rows = spark.read.parquet(path)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    files = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(files), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2) -> DataFrame:
    """Write the tokens of ``docs`` to the shared folder and return them as read back from the files."""
    path = shared_dir(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, path, end_id)
    return read_tokens(docs.sparkSession, path)


def with_crc(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def crc() -> callable:
        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(3)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            return pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(3)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

        return of

    return arrow_map(tokens.select("doc_id", "start", "n_tokens", "ids"), crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
