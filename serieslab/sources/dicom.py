"""Elements of DICOM files: the file meta group, the data set, and the items of sequences in it."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Representations with a four-byte length, those that are numbers, and the syntax without representations.
LONG = ("OB", "OD", "OF", "OL", "OW", "SQ", "UC", "UN", "UR", "UT")
NUMBERS = {"US": "<H", "SS": "<h", "UL": "<I", "SL": "<i", "FL": "<f", "FD": "<d"}
IMPLICIT = "1.2.840.10008.1.2"
# Representations of bytes that are no text, the marks that end an item and a sequence, and the pixels.
BYTES = ("OB", "OD", "OF", "OL", "OW", "SQ", "UN")
IMPLIED = {(0x28, n): "US" for n in (0x2, 0x6, 0x10, 0x11, 0x100, 0x101, 0x102, 0x103)}  # of numbers, where the file doesn't name it
ITEM_END, SEQUENCE_END, PIXELS, UNKNOWN = (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD), (0x7FE0, 0x10), 0xFFFFFFFF


def _head(data: bytes, at: int, implicit: bool) -> tuple[int, int, str, int, int]:
    """Group, element, representation, size and where the value begins."""
    group, element = struct.unpack_from("<HH", data, at)
    kind = data[at + 4 : at + 6].decode("latin-1")
    if group == 0xFFFE or (implicit and group != 2):
        return group, element, "", struct.unpack_from("<I", data, at + 4)[0], at + 8
    if kind in LONG:
        return group, element, kind, struct.unpack_from("<I", data, at + 8)[0], at + 12
    return group, element, kind, struct.unpack_from("<H", data, at + 6)[0], at + 8


def _end(data: bytes, at: int, implicit: bool) -> int:
    """Where a sequence of unknown length that begins at ``at`` ends: its items, and sequences in them, are stepped over."""
    depth = 1
    while depth and at + 8 <= len(data):
        group, element, _, size, at = _head(data, at, implicit)
        if (group, element) == SEQUENCE_END:
            depth -= 1
        elif group == 0xFFFE:
            at += 0 if size == UNKNOWN or (group, element) == ITEM_END else size
        elif size == UNKNOWN:
            depth += 1
        else:
            at += size
    return at


def elements(data: bytes, nested: bool = False) -> Iterator[tuple[str, int, int, str, int, int]]:
    """Place, group, element, representation, begin and size of the elements of a little-endian file; size -1 for pixels in items.

    The place is the tag, with ``nested`` also those within sequences: ``00081115[0]/0020000e`` is an element of
    the first item. Sequences are else stepped over. What is cut off at the end of the file is left out.
    """
    if data[128:132] != b"DICM":
        return
    at, syntax, inside = 132, "", []  # of each open sequence: its place, the number of items, where it and its item end
    while at + 8 <= len(data):
        while inside and at >= inside[-1][2]:
            inside.pop()
        try:
            group, element, kind, size, begin = _head(data, at, syntax == IMPLICIT)
        except struct.error:
            return
        if group == 0xFFFE:
            at = begin
            if (group, element) == SEQUENCE_END and inside:
                inside.pop()
            elif (group, element) != ITEM_END and inside:
                inside[-1][1] += 1
            continue
        prefix = f"{inside[-1][0]}[{inside[-1][1]}]/" if inside else ""
        place = f"{prefix}{group:04x}{element:04x}"
        items = kind == "SQ" or (size == UNKNOWN and (group, element) != PIXELS)
        if size == UNKNOWN and not items:
            yield place, group, element, kind, begin, -1
            return
        if size != UNKNOWN and begin + size > len(data):
            return
        if items and nested:
            inside.append([place, -1, len(data) if size == UNKNOWN else begin + size])
            at = begin
            continue
        if items:
            at = _end(data, begin, syntax == IMPLICIT) if size == UNKNOWN else begin + size
            continue
        if (group, element) == (2, 0x10):
            syntax = data[begin : begin + size].decode("latin-1").strip("\0 ")
        yield place, group, element, kind or IMPLIED.get((group, element), ""), begin, size
        at = begin + size


def tags(data: bytes, nested: bool = False) -> Iterator[tuple[str, str]]:
    """(tag, value) of the elements that hold text or numbers; see :func:`elements`."""
    for place, group, element, kind, begin, size in elements(data, nested):
        if size < 0 or kind in BYTES or (group, element) == PIXELS:
            continue
        form, raw = NUMBERS.get(kind), data[begin : begin + size]
        yield place, str(struct.unpack_from(form, raw)[0]) if form and size >= struct.calcsize(form) else raw.decode("latin-1").strip("\0 ")


def read_tags(files: DataFrame, nested: bool = False) -> DataFrame:
    """path, tag and value of the text elements of files (path, content); with ``nested`` of those in sequences as well.

    A file that is no DICOM file, or null, has none.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *found) for path, content in zip(batch["path"], batch["content"], strict=True) for found in tags(content or b"", nested)]
            yield pd.DataFrame(rows, columns=["path", "tag", "value"])

    return files.select("path", "content").mapInPandas(parse, "path string, tag string, value string")
