"""WARC archives with a two-level capture index."""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslab.llm.common import arrow_map, keep, materialise, numbered

#: Captures of one compressed block of the index.
BLOCK_LINES = 1000
#: Blocks that one task of a search reads, and columns of the directory.
BLOCKS_A_TASK = 16
DIRECTORY = "first_key string, last_key string, file string, offset long, length long"
DATE = "2024-01-01T00:00:00Z"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def clean(url: str | None) -> str:
    """The URL without blanks around it; other blanks and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", (url or "").strip())


def url_key(url: str | None) -> str:
    """The reversed-host sort key: ``http://m.a.org:80/B?x`` becomes ``org,a,m)/b?x``."""
    rest = clean(url).split("://", 1)[-1]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:].split("#", 1)[0]
    host = host.split(":", 1)[0]
    return f"{','.join(reversed(host.split('.')))}){tail.lower() or '/'}"


def record_id(page_id: int | None, row: int) -> str:
    """A page_id may repeat or be null, so the row is part of a record's name."""
    return f"<urn:page:{'none' if page_id is None else page_id}:{row}>"


def page_of(name: str) -> int | None:
    page = name.split(":")[2]
    return None if page == "none" else int(page)


def record(name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit has no payload and names the record that has it."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Target-URI: {clean(url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (without the HTTP head) of one record."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])].split(b"\r\n\r\n", 1)[1]


def _pack(data: bytes) -> bytes:
    return gzip.compress(data, 1, mtime=0)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 100) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) to gzip-member WARC files below ``path``.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest page_id is
    a response and the others revisit it; smaller payloads are all responses. Rows are told apart by a
    row number, so page_ids may repeat or be null: of rows with that page_id the first is the response,
    and a null counts as larger than any number. A null html is an empty payload, a null url an empty
    target. Returns the captures as Spark wrote them: url_key, page_id, file, offset, length; a file is
    named after its task attempt, so files of attempts that were lost are never referred to. Other
    columns are not read.

    Digests are grouped with partial minima before the shuffle; just the rows that revisit are joined
    back by row number, so payloads are shuffled with their page once, whatever they have in common.
    """
    rows = numbered(pages, "row", ["page_id", "url", "html"]).select("row", "page_id", "url", "html")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    seen = keep(rows.select("row", "page_id", F.octet_length("html").alias("n"), F.unhex(F.sha2(payload, 256)).alias("digest")).filter(F.coalesce("n", F.lit(0)) >= min_bytes))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("first")
    repeated = keep(seen.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first"))
    revisits = seen.select("row", "digest").join(repeated, "digest").filter("row <> first.row").select("row", F.col("first.page_id").alias("to_page"), F.col("first.row").alias("to_row"))
    joined = rows.join(revisits, "row", "left").select("row", "page_id", "url", "html", "to_page", "to_row")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(path)
        system.create_dir(folder, recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            found = []
            for row, page_id, url, html, to_page, to_row in zip(*(batch.column(j).to_pylist() for j in range(6)), strict=True):
                out = out or system.open_output_stream(f"{folder}/{name}", compression=None)
                body = (html or "").encode()
                data = _pack(record(record_id(page_id, row), url, body, hashlib.sha256(body).hexdigest(), None if to_row is None else record_id(to_page, to_row)))
                out.write(data)
                found.append((url_key(url), page_id, name, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in found], t) for j, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["url_key", "page_id", "file", "offset", "length"])
        if out:
            out.close()

    captures = joined.mapInArrow(write, "url_key string, page_id long, file string, offset long, length long")
    return materialise(captures, "captures", (seen, repeated))  # runs the writing once; from here on only finished tasks count


def write_index(captures: DataFrame, path: str) -> DataFrame:
    """The two levels: sorted compressed blocks below ``path``/blocks, and the sparse directory.

    Captures are range partitioned and sorted by url_key; each task writes one file of gzip members of
    ``BLOCK_LINES`` lines. The directory, with first_key, last_key, file, offset and length of each
    block, is a sorted table in ``path``/directory, and is returned.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(f"{path}/blocks")
        system.create_dir(folder, recursive=True)
        name, at, out, lines, found = f"{uuid.uuid4().hex}.cdx.gz", 0, None, [], []

        def flush() -> None:
            nonlocal at, out
            out = out or system.open_output_stream(f"{folder}/{name}", compression=None)
            data = _pack("\n".join("\t".join(map(str, x)) for x in lines).encode())
            out.write(data)
            found.append((lines[0][0], lines[-1][0], name, at, len(data)))
            at += len(data)
            lines.clear()

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(line)
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out:
            out.close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["first_key", "last_key", "file", "offset", "length"])

    tie = F.xxhash64("file", "offset")  # captures of one key may be dealt over several blocks and files
    ordered = captures.repartitionByRange("url_key", tie).sortWithinPartitions("url_key", "file", "offset")
    blocks = ordered.select("url_key", "file", "offset", "length").mapInArrow(write, DIRECTORY)
    blocks.write.parquet(f"{path}/directory")
    return captures.sparkSession.read.schema(DIRECTORY).parquet(f"{path}/directory")


def read_block(system: fs.FileSystem, folder: str, file: str, offset: int, length: int) -> list[list[str]]:
    """Lines of a block: url_key, file, offset and length of each capture."""
    with system.open_input_file(f"{folder}/{file}") as f:
        return [line.split("\t") for line in zlib.decompress(f.read_at(length, offset), 31).decode().split("\n")]


class Directory:
    """The part of the sparse directory that covers the keys from ``low`` to ``high``: other row groups are not read."""

    def __init__(self, path: str, low: str, high: str) -> None:
        system, folder = _open(f"{path}/directory")
        table = dataset.dataset(folder, filesystem=system, format="parquet", schema=pa.schema([(n, pa.string() if n in ("first_key", "last_key", "file") else pa.int64()) for n in ("first_key", "last_key", "file", "offset", "length")]))
        found = table.to_table(filter=(dataset.field("last_key") >= low) & (dataset.field("first_key") <= high))
        self.rows = sorted(zip(*(c.to_pylist() for c in found.columns), strict=True))
        self.ends = [r[1] for r in self.rows]

    def blocks(self, key: str) -> list[tuple[str, int, int]]:
        """Blocks that may hold the key, by binary search."""
        out = []
        for first, _, file, offset, length in self.rows[bisect.bisect_left(self.ends, key) :]:
            if first > key:
                break
            out.append((file, offset, length))
        return out


def lookup(index_path: str, warc_path: str, url: str) -> list[tuple[dict[str, str], bytes]]:
    """Records of one URL: binary search in the sparse directory, then range reads of blocks and records."""
    key = url_key(url)
    found, (system, index), (_, warc) = [], _open(f"{index_path}/blocks"), _open(warc_path)
    for block in Directory(index_path, key, key).blocks(key):
        for _, file, offset, length in (x for x in read_block(system, index, *block) if x[0] == key):
            with system.open_input_file(f"{warc}/{file}") as f:
                found.append(parse(zlib.decompress(f.read_at(int(length), int(offset)), 31)))
    return found


def keys_of(urls: DataFrame) -> DataFrame:
    """Distinct url_keys of the column ``url``."""

    def key() -> callable:
        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], ["url_key"])

        return of

    return arrow_map(urls.select("url"), key, "url_key string").distinct()


def search(keys: DataFrame, index_path: str) -> DataFrame:
    """Places (file, offset, length) of all captures of the distinct ``keys`` (column url_key), through the index.

    Keys are sorted by range; a task reads the directory for its range only and finds the blocks of each
    key by binary search. Blocks are dealt anew with the keys sought in them, so a key with captures in
    very many blocks doesn't land in one task, and each one reads its blocks by range.
    """
    n = keys.sparkSession.read.schema(DIRECTORY).parquet(f"{index_path}/directory").count()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, wanted = batch.column(0).to_pylist(), {}
            if own:
                directory = Directory(index_path, own[0], own[-1])
                for key in own:
                    for block in directory.blocks(key):
                        wanted.setdefault(block, []).append(key)
            columns = [pa.array([b[j] for b in wanted], t) for j, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(wanted.values()), pa.list_(pa.string()))], ["file", "offset", "length", "keys"])

    def entries() -> callable:
        system, folder = _open(f"{index_path}/blocks")

        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for file, offset, length, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = set(keys)
                found += [x for x in read_block(system, folder, file, offset, length) if x[0] in own]
            return pa.RecordBatch.from_arrays([pa.array([x[1] for x in found], pa.string()), pa.array([int(x[2]) for x in found], pa.int64()), pa.array([int(x[3]) for x in found], pa.int64())], ["file", "offset", "length"])

        return of

    blocks = keys.repartitionByRange("url_key").sortWithinPartitions("url_key").mapInArrow(probe, "file string, offset long, length long, keys array<string>")
    return arrow_map(blocks.repartition(-(-max(1, n) // BLOCKS_A_TASK), "file", "offset"), entries, "file string, offset long, length long")


def read_warc(keys: DataFrame, index_path: str, warc_path: str) -> DataFrame:
    """The records of ``keys``, read back through the index: record_id, url, page_id, payload, payload_bytes, payload_digest, record_type, refers_to, refers_id.

    Captures are dealt by WARC file and place, so that a task reads its stretch of a file in order. A
    revisit's payload and size are null here.
    """

    def records() -> callable:
        system, folder = _open(warc_path)
        last, handle = None, None

        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal last, handle
            rows = []
            for file, offset, length in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                if file != last:
                    last, handle = file, system.open_input_file(f"{folder}/{file}")
                fields, payload = parse(zlib.decompress(handle.read_at(length, offset), 31))
                whole, refers, name = fields["WARC-Type"] == "response", fields.get("WARC-Refers-To"), fields["WARC-Record-ID"]
                digest = hashlib.sha256(payload).hexdigest() if whole else fields["WARC-Payload-Digest"][7:]
                rows.append((name, fields["WARC-Target-URI"], page_of(name), payload if whole else None, len(payload) if whole else None, digest, fields["WARC-Type"], page_of(refers) if refers else None, refers))
            types = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], ["record_id", "url", "page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_id"])

        return of

    places = search(keys, index_path).repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return arrow_map(places, records, "record_id string, url string, page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_id string")


def archive(pages: DataFrame, path: str, min_bytes: int = 100) -> DataFrame:
    """Write the records and the index of ``pages`` below ``path`` and return the block directory."""
    return write_index(write_warc(pages, f"{path}/warc", min_bytes), f"{path}/index")


def resolved(records: DataFrame) -> DataFrame:
    """Page rows without payloads: a revisit takes size and digest from the response that it refers to."""
    small = materialise(records.drop("payload", "url"), "records")
    whole = small.filter("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"))
    revisits = small.filter("record_type = 'revisit'").join(whole, "refers_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    out = revisits.select("page_id", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to")
    return small.filter("record_type = 'response'").select(columns).unionByName(out)
