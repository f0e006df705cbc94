"""Sinks: sorted JSON documents and archives."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, key: str) -> None:
    """JSON lines in the order of ``key`` over the files together."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.json(path)


def zip_chunks(files: DataFrame, most: int = 90 << 20) -> DataFrame:
    """Archives (study, chunk, content) of files (study, name, content), each of at most ``most`` bytes before packing.

    Files fill chunks in the order of their names; a larger file has a chunk of its own.
    """
    from serieslab.operators.dedup import greedy_chunks

    sized = files.withColumn("size", F.length("content"))
    placed = sized.join(greedy_chunks(sized, "study", "name", "size", most).drop("size"), ["study", "name"])

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in sorted(zip(group["name"], group["content"], strict=True)):
                z.writestr(zipfile.ZipInfo(name), content)
        return pd.DataFrame({"study": [group["study"].iloc[0]], "chunk": [group["chunk"].iloc[0]], "content": [out.getvalue()]})

    return placed.select("study", "chunk", "name", "content").groupBy("study", "chunk").applyInPandas(pack, "study string, chunk long, content binary")
