"""Pixels of DICOM files: frames, their windows, grey levels and signatures."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.session import bounded_batches
from serieslab.sources.dicom import PIXELS, elements, tags

#: Bytes of frames after which they leave a task as a batch, and what a frame takes besides its pixels.
BATCH_BYTES, FRAME_BYTES = 4 << 20, 8 << 10
#: Side of the grid of a signature.
GRID = 24
# Tags of the description of an image.
TAGS = {"frames": "00280008", "rows": "00280010", "cols": "00280011", "bits": "00280100", "signed": "00280103", "samples": "00280002", "photometric": "00280004", "slope": "00281053", "intercept": "00281052", "centre": "00281050", "width": "00281051"}
DEFAULTS = {"frames": 1, "rows": 0, "cols": 0, "bits": 8, "signed": 0, "samples": 1}


@dataclass
class Image:
    """The description of an image, its bytes, and where its frames lie in them."""

    info: dict
    data: bytes
    places: list[tuple[int, int]]
    packed: bool

    def stored(self, frame: int) -> np.ndarray:
        """Stored values of a frame, rows x columns (the first plane's bytes, if there are several samples)."""
        i, (begin, _) = self.info, self.places[frame]
        kind = ("<i2" if i["signed"] == 1 else "<u2") if i["bits"] == 16 else ("i1" if i["signed"] == 1 else "u1")
        return np.frombuffer(self.data, kind, i["rows"] * i["cols"], begin).reshape(i["rows"], i["cols"]).astype(np.int32)


def _number(text: str | None) -> float | None:
    """The first of the numbers of an element, None if that is none."""
    try:
        return float((text or "").split("\\")[0])
    except ValueError:
        return None


def image_of(data: bytes) -> tuple[Image | None, str | None]:
    """The image of a file, or why there is none."""
    if data[128:132] != b"DICM":
        return None, "no DICOM file"
    found = dict(tags(data))
    info = {k: _number(found.get(tag)) for k, tag in TAGS.items() if k != "photometric"}
    info |= {k: int(info[k] or least) for k, least in DEFAULTS.items()} | {"photometric": found.get(TAGS["photometric"], "MONOCHROME2")}
    pixels = next(((b, n) for _, g, e, _, b, n in elements(data) if (g, e) == PIXELS), None)
    if pixels is None or not info["rows"] or not info["cols"]:
        return None, "no pixels"
    begin, size = pixels
    if size < 0:
        places = list(_items(data, begin))
        return (Image(info, data, places, True), None) if places else (None, "no frames")
    each = info["rows"] * info["cols"] * (info["bits"] // 8) * info["samples"]
    places = [(begin + f * each, each) for f in range(info["frames"]) if (f + 1) * each <= size and each]
    return (Image(info, data, places, False), None) if places else (None, "no frames")


def _items(data: bytes, at: int) -> Iterator[tuple[int, int]]:
    """Items with bytes in them of pixels that are packed one by one."""
    while at + 8 <= len(data) and data[at : at + 4] == b"\xfe\xff\x00\xe0":
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        at += 8
        if 0 < size and at + size <= len(data):
            yield at, size
        at += size


def window(low: float, high: float, centre: float | None, width: float | None) -> tuple[float, float]:
    """Centre and width: the given ones, or those of the range of values if they are missing or there is no width."""
    if centre is None or width is None or width <= 0:
        return (low + high) / 2, (high - low if high > low else 1)
    return centre, width


def grey_levels(stored: np.ndarray, info: dict) -> tuple[np.ndarray, int, int, float, float]:
    """Grey levels of 0 to 255, least and largest rescaled value, centre and width.

    Rescaled values are whole numbers, cut towards zero; halves of grey levels go up; MONOCHROME1 has
    low values bright.
    """
    slope, intercept = (info["slope"] if info["slope"] is not None else 1.0), (info["intercept"] if info["intercept"] is not None else 0.0)
    values = np.trunc(stored * slope + intercept)
    low, high = int(values.min()), int(values.max())
    centre, width = window(low, high, info["centre"], info["width"])
    share = np.clip((values - (centre - width / 2)) / width, 0, 1)
    if info["photometric"] == "MONOCHROME1":
        share = 1 - share
    return np.floor(share * 255 + 0.5).astype(np.uint8), low, high, centre, width


def signature(grey: np.ndarray, grid: int = GRID) -> np.ndarray:
    """Mean brightness, 0 to 1, of ``grid`` x ``grid`` blocks of equal size from the upper left; rows and columns beyond them don't count, and a block beyond the image is 0."""
    rows, cols = grey.shape
    high, wide = max(1, rows // grid), max(1, cols // grid)
    part = grey[: high * grid, : wide * grid].astype(float)
    sums = np.add.reduceat(np.add.reduceat(part, np.arange(0, part.shape[0], high), 0), np.arange(0, part.shape[1], wide), 1) / (high * wide)
    out = np.zeros((grid, grid))
    out[: sums.shape[0], : sums.shape[1]] = sums / 255
    return out.ravel()


def read_frames(files: DataFrame, grid: int = GRID, pixels: bool = False) -> DataFrame:
    """One row for each frame of the DICOM files (path, content), with its window and signature.

    Returns path, frame, n_frames, rows, cols, low, high, centre, width (of rescaled values), signature
    (``grid`` * ``grid`` means of grey levels from 0 to 1), grey (a byte a pixel, with ``pixels``),
    packed (the bytes of a frame in a compressed syntax, which is not decoded: such frames have no window
    and no signature) and error. A file without frames gives one row with the error; a null content is
    no DICOM file. Other columns are not read.

    Files are read one at a time in a task and frames leave it in batches of about ``BATCH_BYTES``, so memory follows
    the largest file, not the number of frames; nothing is shuffled.
    """
    bounded_batches(files.sparkSession)
    schema = "path string, frame int, n_frames int, rows int, cols int, low long, high long, centre double, width double, signature array<double>, grey binary, packed binary, error string"
    types = [pa.string(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.string()]
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def rows_of(path: str, content: bytes) -> Iterator[tuple]:
        image, error = image_of(content)
        if image is None:
            yield (path, *[None] * 11, error)
            return
        n, size = len(image.places), (image.info["rows"], image.info["cols"])
        for f, (begin, length) in enumerate(image.places):
            if image.packed:
                yield (path, f, n, *size, *[None] * 6, content[begin : begin + length], "compressed")
                continue
            grey, *found = grey_levels(image.stored(f), image.info)
            yield (path, f, n, *size, *found, signature(grey, grid), grey.tobytes() if pixels else None, None, None)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                for row in rows_of(path.as_py(), content.as_py() or b""):
                    held.append(row)
                    size += FRAME_BYTES + len(row[10] or b"") + len(row[11] or b"")
                    if size >= BATCH_BYTES:
                        yield batch_of(held)
                        held, size = [], 0
        if held:
            yield batch_of(held)

    return files.select("path", "content").mapInArrow(run, schema)


def brightness(grey: Column | str) -> Column:
    """Sum of the grey levels of a frame, null if there are none."""

    def total(frames: pd.Series) -> pd.Series:
        return frames.map(lambda g: None if g is None else int(np.frombuffer(g, np.uint8).sum(dtype=np.int64))).astype("Int64")

    return F.pandas_udf(total, "long")(grey)


def pixel_rows(files: DataFrame) -> DataFrame:
    """path, frame, y and values: the stored values of each row of the uncompressed frames of files (path, content)."""
    bounded_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                image, _ = image_of(content.as_py() or b"")
                for f in range(len(image.places) if image and not image.packed else 0):
                    values = image.stored(f)
                    n = len(values)
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * n), pa.array([f] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(list(values), pa.list_(pa.int32()))], ["path", "frame", "y", "values"])

    return files.select("path", "content").mapInArrow(run, "path string, frame int, y int, values array<int>")
