"""Files of images built here: pixels to windows, grey levels, signatures and pairs, against plain numpy."""

import struct

import numpy as np
import pytest

from serieslab.operators import dedup
from serieslab.queries.images import element
from serieslab.sources import dicom, pixels

ITEM, ITEM_END, ALL_END = b"\xfe\xff\x00\xe0", b"\xfe\xff\x0d\xe0\0\0\0\0", b"\xfe\xff\xdd\xe0\0\0\0\0"


def plain(group, number, value):
    """An element of the syntax without representations."""
    return struct.pack("<HHI", group, number, len(value)) + value


def image(stored, bits=16, signed=0, photometric=b"MONOCHROME2", slope=None, intercept=None, centre=None, width=None, frames=1, implicit=False, pixels=None):
    put = (lambda g, n, kind, v: plain(g, n, v + b" " * (len(v) % 2))) if implicit else element
    rows, cols = stored.shape[-2:]
    us = lambda n, v: put(0x28, n, "US", struct.pack("<H", v))
    data = b"\0" * 128 + b"DICM" + element(2, 0x10, "UI", b"1.2.840.10008.1.2" if implicit else b"1.2.840.10008.1.2.1")
    data += us(0x2, 1) + put(0x28, 0x4, "CS", photometric) + put(0x28, 0x8, "IS", str(frames).encode()) + us(0x10, rows) + us(0x11, cols) + us(0x100, bits) + us(0x103, signed)
    for number, value in ((0x1050, centre), (0x1051, width), (0x1052, intercept), (0x1053, slope)):
        data += put(0x28, number, "DS", value) if value is not None else b""
    kind = ("<i2" if signed else "<u2") if bits == 16 else ("i1" if signed else "u1")
    return data + (pixels if pixels is not None else put(0x7FE0, 0x10, "OW", stored.astype(kind).tobytes()))


def loops(stored, slope=1.0, intercept=0.0, centre=None, width=None, inverted=False):
    """Grey levels and cells one by one."""
    values = [[int(v * slope + intercept) for v in row] for row in stored.tolist()]
    low, high = min(map(min, values)), max(map(max, values))
    if centre is None or width is None or width <= 0:
        centre, width = (low + high) / 2, max(high - low, 1)
    grey = []
    for row in values:
        shares = [min(1.0, max(0.0, (v - (centre - width / 2)) / width)) for v in row]
        grey.append([int(np.floor((1 - s if inverted else s) * 255 + 0.5)) for s in shares])
    h, w = max(1, len(grey) // 24), max(1, len(grey[0]) // 24)
    cells = []
    for gy in range(24):
        for gx in range(24):
            own = [v for row in grey[gy * h : gy * h + h] for v in row[gx * w : gx * w + w]]
            cells.append(sum(own) / len(own) / 255 if own else 0)
    return grey, low, high, centre, width, cells


@pytest.mark.parametrize("implicit", [False, True])
def test_frames(spark, implicit):
    rng = np.random.default_rng(1)
    cases = {
        "wide": (rng.integers(0, 4000, (3, 61, 100)), {"frames": 3}, {}),
        "signed": (rng.integers(-900, 900, (1, 24, 30)), {"signed": 1, "slope": b"0.5", "intercept": b"-3.25"}, {"slope": 0.5, "intercept": -3.25}),
        "inverted": (rng.integers(0, 255, (1, 10, 7)), {"bits": 8, "photometric": b"MONOCHROME1"}, {"inverted": True}),
        "window": (rng.integers(-128, 127, (1, 50, 50)), {"bits": 8, "signed": 1, "centre": b"40\\7", "width": b"80\\9"}, {"centre": 40.0, "width": 80.0}),
        "no width": (rng.integers(0, 9, (1, 5, 5)), {"bits": 8, "centre": b"4", "width": b"0"}, {}),
        "flat": (np.full((1, 30, 30), 7), {}, {}),
        "odd text": (rng.integers(0, 9, (1, 4, 4)), {"centre": b"x", "width": b"y"}, {}),
    }
    files = [(name, image(stored, implicit=implicit, **given)) for name, (stored, given, _) in cases.items()]
    got = {(r.path, r.frame): r for r in pixels.read_frames(spark.createDataFrame(files, "path string, content binary"), pixels=True).collect()}
    assert len(got) == sum(len(s) for s, *_ in cases.values())
    for name, (stored, _, how) in cases.items():
        for f, plane in enumerate(stored):
            r, (grey, low, high, centre, width, cells) = got[name, f], loops(plane, **how)
            assert (r.n_frames, r.rows, r.cols, r.low, r.high, r.centre, r.width, r.error) == (len(stored), *plane.shape, low, high, centre, width, None)
            assert list(r.grey) == sum(grey, [])
            assert r.signature == pytest.approx(cells)
    rows = {(r.path, r.frame, r.y): r["values"] for r in pixels.pixel_rows(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert all(rows[name, f, y] == own.tolist() for name, (stored, *_) in cases.items() for f, plane in enumerate(stored) for y, own in enumerate(plane))


def test_files_without_frames(spark):
    stored = np.zeros((1, 4, 4))
    packed = struct.pack("<HH", 0x7FE0, 0x10) + b"OB\0\0\xff\xff\xff\xff" + ITEM + b"\0\0\0\0" + ITEM + struct.pack("<I", 4) + b"\xff\xd8ab" + ITEM + struct.pack("<I", 2) + b"cd" + ALL_END
    files = [("none", b"text"), ("null", None), ("no pixels", image(stored, pixels=b"")), ("short", image(stored, pixels=element(0x7FE0, 0x10, "OW", b"ab"))), ("cut", image(stored)[:-9]), ("packed", image(stored, pixels=packed))]
    got = {(r.path, r.frame): (r.error, r.packed) for r in pixels.read_frames(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got == {
        ("none", None): ("no DICOM file", None), ("null", None): ("no DICOM file", None), ("no pixels", None): ("no pixels", None), ("short", None): ("no frames", None),
        ("cut", None): ("no pixels", None), ("packed", 0): ("compressed", b"\xff\xd8ab"), ("packed", 1): ("compressed", b"cd"),
    }
    assert pixels.read_frames(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_nested_tags(spark):
    inner = element(0x20, 0xE, "UI", b"1.2.3")
    known = element(0x8, 0x1115, "SQ", ITEM + struct.pack("<I", len(inner)) + inner + ITEM + struct.pack("<I", len(inner)) + inner)
    deep = b"\x08\0\x40\x11SQ\0\0\xff\xff\xff\xff" + ITEM + b"\xff\xff\xff\xff" + element(8, 0x1150, "UI", b"1.9") + known + ITEM_END + ALL_END
    data = b"\0" * 128 + b"DICM" + element(2, 0x10, "UI", b"1.2.840.10008.1.2.1") + known + deep + element(0x10, 0x10, "PN", b"Ana")
    want = {
        "00020010": "1.2.840.10008.1.2.1", "00081115[0]/0020000e": "1.2.3", "00081115[1]/0020000e": "1.2.3", "00081140[0]/00081150": "1.9",
        "00081140[0]/00081115[0]/0020000e": "1.2.3", "00081140[0]/00081115[1]/0020000e": "1.2.3", "00100010": "Ana",
    }
    frame = spark.createDataFrame([("a", data)], "path string, content binary")
    assert {r.tag: r.value for r in dicom.read_tags(frame, nested=True).collect()} == want
    assert {r.tag: r.value for r in dicom.read_tags(frame).collect()} == {k: v for k, v in want.items() if "/" not in k}


def test_like_frames(spark):
    """Pixels to signatures to pairs: a lighter copy is near, an inverted one is not."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 200, (1, 48, 48))
    files = spark.createDataFrame([("a", image(base)), ("b", image(base + rng.integers(0, 9, base.shape))), ("c", image(base, photometric=b"MONOCHROME1"))], "path string, content binary")
    from pyspark.sql import functions as F

    frames = pixels.read_frames(files).select(F.lit("s").alias("study"), "path", "signature")
    sig = {r.path: np.array(r.signature) for r in frames.collect()}
    got = {(r.a, r.b): r["diff"] for r in dedup.pairs_below(frames, "study", "path", "signature", 0.1).collect()}
    assert got == {("a", "b"): pytest.approx(np.abs(sig["a"] - sig["b"]).mean())}
    assert np.abs(sig["a"] - sig["c"]).mean() > 0.1


def test_brightness(spark):
    """The sum of the bytes of each of many frames, none for a file without frames; files come from several rows of a batch."""
    stored = np.arange(5 * 30 * 30).reshape(5, 30, 30)
    files = spark.createDataFrame([*((str(i), image(stored, frames=5)) for i in range(4)), ("none", b"")], "path string, content binary").coalesce(1)
    read = pixels.read_frames(files, pixels=True)
    got = {(r.path, r.frame): (r.grey, r.total) for r in read.withColumn("total", pixels.brightness("grey")).collect()}
    assert len(got) == 21 and got.pop(("none", None)) == (None, None) and all(t == sum(g) for g, t in got.values())
