"""Images in DICOM files, which are put together from the vectors of ``embeddings``."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.operators import dedup
from serieslab.queries.registry import query
from serieslab.session import table
from serieslab.sources import pixels

#: Rows, columns and frames of an image; pixel (f, y, x) is place (f + 7 y + x) % 64 of a vector, in thousandths.
SIDE, FRAMES = (50, 53), 2


def element(group: int, number: int, kind: str, value: bytes) -> bytes:
    value += b" " * (len(value) % 2)
    size = b"\0\0" + struct.pack("<I", len(value)) if kind in ("OB", "OW", "SQ") else struct.pack("<H", len(value))
    return struct.pack("<HH", group, number) + kind.encode() + size + value


def files(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, path and content of an image for each vector: some inverted, some with a window of their own, values with a sign."""
    us = lambda n, v: element(0x28, n, "US", struct.pack("<H", v))
    meta = b"\0" * 128 + b"DICM" + element(2, 0x10, "UI", b"1.2.840.10008.1.2.1") + us(0x2, 1)
    kind = lambda name: F.lit(element(0x28, 0x4, "CS", name))
    shape = element(0x28, 0x8, "IS", str(FRAMES).encode()) + us(0x10, SIDE[0]) + us(0x11, SIDE[1]) + us(0x100, 16) + us(0x103, 1)
    own = element(0x28, 0x1050, "DS", b"20\\3") + element(0x28, 0x1051, "DS", b"150\\9")
    scale = element(0x28, 0x1052, "DS", b"-10") + element(0x28, 0x1053, "DS", b"0.5")
    size = SIDE[0] * SIDE[1] * FRAMES * 2
    head = struct.pack("<HH", 0x7FE0, 0x10) + b"OW\0\0" + struct.pack("<I", size)

    def hexed(v: Column) -> Column:
        number = F.lpad(F.hex(F.round(v.cast("double") * 1000).cast("long") + 65536), 5, "0")
        return F.concat(F.right(number, F.lit(2)), F.substring(number, 2, 2))

    cycle = F.array_join(F.transform("embedding", hexed), "")  # 64 places; a row is that many from its own place on
    row = lambda c, f, y: F.substr(c, ((f + y * 7) % 64) * 4 + 1, F.lit(SIDE[1] * 4))
    upto = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    rows = lambda c: F.flatten(F.transform(upto(FRAMES), lambda f: F.transform(upto(SIDE[0]), lambda y: row(c, f, y))))
    frames = F.transform(F.array(F.repeat(cycle, 2)), lambda c: F.array_join(rows(c), ""))[0]  # an array of one, so that the cycle is made once, not for each row
    odd, third = F.col("vec_id") % 2 == 1, F.col("vec_id") % 3 == 0
    content = F.concat(F.lit(meta), F.when(odd, kind(b"MONOCHROME1")).otherwise(kind(b"MONOCHROME2")), F.lit(shape), F.when(third, F.lit(own)).otherwise(F.lit(b"")), F.lit(scale), F.lit(head), F.unhex(frames))
    vectors = table(spark, d, "embeddings").repartition("vec_id")  # a file is forty times its vector, so tasks are dealt files, not bytes of vectors
    return vectors.select("vec_id", "label", F.concat(F.lit("image "), F.col("vec_id").cast("string")).alias("path"), content.alias("content"))


GREY_SQL = f"""WITH px AS (SELECT vec_id, label, f, y, x, trunc(round(embedding[(f + 7 * y + x) % 64 + 1]::DOUBLE * 1000) * 0.5 - 10)::BIGINT AS v FROM embeddings, range({FRAMES}) a(f), range({SIDE[0]}) b(y), range({SIDE[1]}) c(x)),
lim AS (SELECT vec_id, f, min(v) AS low, max(v) AS high FROM px GROUP BY ALL),
win AS (SELECT *, CASE WHEN vec_id % 3 = 0 THEN 20.0::DOUBLE ELSE (low + high) / 2 END AS centre, CASE WHEN vec_id % 3 = 0 THEN 150.0::DOUBLE ELSE greatest(high - low, 1) END AS width FROM lim),
grey AS (SELECT vec_id, label, f, y, x, low, high, centre, width, floor((CASE WHEN vec_id % 2 = 1 THEN 1 - s ELSE s END) * 255 + 0.5)::BIGINT AS g FROM (SELECT *, greatest(0.0, least(1.0, (v - (centre - width / 2)) / width)) AS s FROM px JOIN win USING (vec_id, f))),
sig AS (SELECT vec_id, label, f, y // 2 AS gy, x // 2 AS gx, sum(g) / 4.0 / 255 AS s FROM grey WHERE y < 48 AND x < 48 GROUP BY ALL)"""


@query(GREY_SQL + " SELECT vec_id, f::INT AS frame, min(low) AS low, max(high) AS high, min(centre) AS centre, max(width) AS width, sum(g)::BIGINT AS grey FROM grey GROUP BY vec_id, f")
def frame_windows(spark: SparkSession, d: str) -> DataFrame:
    """Range, window and sum of grey levels of each frame of the images' files."""
    made = files(spark, d)
    read = pixels.read_frames(made, pixels=True)
    return read.select(F.substring("path", 7, 20).cast("long").alias("vec_id"), "frame", "low", "high", "centre", "width", pixels.brightness("grey").alias("grey"))


@query(GREY_SQL + " SELECT vec_id, f::INT AS frame, (gy * 24 + gx)::INT AS cell, round(s, 6) AS mean FROM sig")
def frame_signatures(spark: SparkSession, d: str) -> DataFrame:
    """The 576 cells of each frame's signature."""
    read = pixels.read_frames(files(spark, d))
    cells = read.select(F.substring("path", 7, 20).cast("long").alias("vec_id"), "frame", F.posexplode("signature").alias("cell", "mean"))
    return cells.withColumn("mean", F.round("mean", 6))


@query(GREY_SQL + """, whole AS (SELECT vec_id, label, list(s ORDER BY gy, gx) AS v FROM sig WHERE f = 0 GROUP BY vec_id, label)
SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM whole a JOIN whole b ON a.label = b.label AND a.vec_id // 40 = b.vec_id // 40 AND a.vec_id < b.vec_id
WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2]))) / 576 <= 0.3""")
def like_images(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of images of a study of up to forty with first frames that look alike."""
    made = files(spark, d)
    study = made.select("path", "vec_id", "label", F.concat_ws("/", "label", F.floor(F.col("vec_id") / 40)).alias("study"))
    first = pixels.read_frames(made).filter("frame = 0").join(study, "path")
    pairs = dedup.pairs_below(first.select("study", "vec_id", "signature"), "study", "vec_id", "signature", 0.3)
    return pairs.select(F.split_part("study", F.lit("/"), F.lit(1)).cast("int").alias("label"), "a", "b")
