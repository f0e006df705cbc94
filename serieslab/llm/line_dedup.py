"""Repeated lines, found with two Bloom filters and confirmed exactly."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslab.llm import bloom
from serieslab.llm.common import Blocks, arrow_map, by_block, folder_of, keep, numbered

#: What is stripped from both ends of a line for its key.
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Documents of a block (as a power of two), and lines about which each shard of the filters is made for.
BLOCK, SHARD = 13, 1 << 23


def keys_of(text: bytes, min_chars: int = 1) -> list[bytes | None]:
    """The key of each line of a text whose A-Z are already lower-cased; None where it is too short."""
    keys = [line.strip(BLANK) for line in text.split(b"\n")]
    if min_chars <= 1:
        return [k or None for k in keys]
    return [k if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode("utf-8", "replace")) >= min_chars) else None for k in keys]


def _texts(column: pa.Array) -> list[bytes]:
    return pc.ascii_lower(pc.fill_null(column, "")).cast(pa.binary()).to_pylist()


def _hashed(column: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Text number, hash and key of each text's distinct lines."""
    keys = [[k for k in set(keys_of(t, min_chars)) if k] for t in _texts(column)]
    flat = [k for own in keys for k in own]
    return np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat)), flat


def _suspected(bits: int) -> callable:
    """Of one shard of the hashes: those seen twice or suspected of it, for each block that has them."""

    def decide(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, filters = [], bloom.OnceTwice(bits)
        for part in parts:
            for block, hashes, many in zip(*(part.column(j).to_pylist() for j in (1, 2, 3)), strict=True):
                found.append((block, hashes))
                own = np.frombuffer(hashes, np.uint64)
                filters.see(own)
                bloom.add(filters.twice, bits, own[np.frombuffer(many, bool)])
        for i in range(0, len(found), 1000):
            rows = [(block, own[bloom.contains(filters.twice, bits, own)]) for block, own in ((b, np.frombuffer(h, np.uint64)) for b, h in found[i : i + 1000])]
            rows = [(block, own.tobytes()) for block, own in rows if len(own)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["block", "hashes"])

    decide.__annotations__ = {"parts": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return decide


def line_dedup(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep_first: bool = False, shard_lines: int = SHARD) -> DataFrame:
    """Drop lines whose key is found in at least ``min_docs`` documents.

    A line ends at \\n; a null or empty text is one empty line. Its key is the line without blanks
    [\\x20\\x09-\\x0D] at both ends and with A-Z lower-cased; keys under ``min_chars`` code points
    always stay. With ``keep_first`` the first line with the key in the document with the smallest
    doc_id stays (of repeated doc_ids the first row), else all go. Each input row is one document, also
    where doc_ids repeat. Returns doc_id, text (the lines that stay, joined by \\n; never null), n_lines,
    n_dropped. Other columns of ``docs`` are not read; an empty table gives no rows.

    First scan: each block of 8192 documents sends the hashes of its distinct keys to shards by hash.
    A shard is made for about ``shard_lines`` lines, so the number of shards, not their size, follows
    the input; it puts its hashes into a once-seen and a twice-seen filter of 8 bits a line and answers
    each block with the hashes that the twice-seen filter lets through. A line of very many documents is
    one hash a block. Second scan: tasks look up the answers for their blocks, and only keys that are
    among them are shuffled and counted exactly, with partial counts before the shuffle. Third scan:
    tasks look up what their blocks lose. So neither texts nor filters are shuffled or broadcast.
    """
    base = numbered(docs, "row", ["doc_id", "text"]).select("row", "doc_id", "text")
    lines = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    lines = lines[0] // 64 + lines[1]
    shards = -(-max(1, lines) // shard_lines)

    def hashes() -> callable:
        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc, h, _ = _hashed(batch.column(1), min_chars)
            block, rows = batch.column(0).to_numpy()[doc] >> BLOCK, []
            for b in np.unique(block).tolist():
                own, count = np.unique(h[block == b], return_counts=True)
                shard = (own >> np.uint64(32)).astype(np.int64) % shards
                for s in np.unique(shard).tolist():
                    rows.append((s, b, own[shard == s].tobytes(), (count[shard == s] > 1).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "block", "hashes", "many"])

        return of

    sent = arrow_map(base.select("row", "text"), hashes, "shard long, block long, hashes binary, many binary")
    answers = by_block(sent.groupBy("shard").applyInArrow(_suspected(bloom.bits_for(min(lines, shard_lines), 8 * SHARD)), "block long, hashes binary"), "line-suspects")
    folder = folder_of(answers)

    def suspects() -> callable:
        blocks = Blocks(folder)
        load = lambda t: np.sort(np.frombuffer(b"".join(t.column("hashes").to_pylist()), np.uint64))

        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc, h, flat = _hashed(batch.column(2), min_chars)
            block, hit = batch.column(0).to_numpy()[doc] >> BLOCK, np.zeros(len(h), bool)
            for b in np.unique(block).tolist():
                own = blocks.of(b, load)
                if len(own):
                    at = np.flatnonzero(block == b)
                    hit[at] = own[np.minimum(np.searchsorted(own, h[at]), len(own) - 1)] == h[at]
            hit = np.flatnonzero(hit)
            return pa.RecordBatch.from_arrays([*(batch.column(j).take(pa.array(doc[hit])) for j in (0, 1)), pa.array([flat[i] for i in hit], pa.binary())], ["row", "doc_id", "key"])

        return of

    # both are kept, so that a key of very many documents is split in the join
    seen = keep(arrow_map(base, suspects, "row long, doc_id long, key binary"))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    repeated = keep(seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"), least).filter(F.col("n") >= min_docs).select("key", F.col("first.row").alias("first")))
    drops = seen.join(repeated, "key").select(F.shiftright("row", BLOCK).alias("block"), "row", "key", (F.lit(keep_first) & (F.col("row") == F.col("first"))).alias("own"))
    lost = folder_of(by_block(drops, "line-drops", (seen, repeated, answers)))

    def drop() -> callable:
        blocks = Blocks(lost)

        def load(table: pa.Table) -> dict[int, dict[bytes, bool]]:
            out = defaultdict(dict)
            for row, key, own in zip(*(table.column(c).to_pylist() for c in ("row", "key", "own")), strict=True):
                out[row][key] = own
            return out

        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for row, low, text in zip(batch.column(0).to_pylist(), _texts(batch.column(2)), pc.fill_null(batch.column(2), "").cast(pa.binary()).to_pylist(), strict=True):
                gone = blocks.of(row >> BLOCK, load).get(row)
                if not gone:
                    out.append((text, text.count(b"\n") + 1, 0))
                    continue
                own, kept, all_lines = dict(gone), [], text.split(b"\n")
                for key, line in zip(keys_of(low, min_chars), all_lines, strict=True):
                    if key is None or key not in own:
                        kept.append(line)
                    elif own[key]:
                        kept.append(line)
                        own[key] = False
                out.append((b"\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array([x[0] for x in out], pa.binary()).cast(pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

        return of

    return arrow_map(base, drop, "doc_id long, text string, n_lines long, n_dropped long")
