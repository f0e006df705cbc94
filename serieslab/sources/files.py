"""Folders of files, archives and byte signatures."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.functions.text import UNSAFE_EXT, extension


def scan_folder(spark: SparkSession, path: str, pattern: str = "*.pdf", content: bool = False) -> DataFrame:
    """path, name, size, modified and sha1 of the files below a folder; their bytes only if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    out = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha1("content").alias("sha1"), "content")
    return out if content else out.drop("content")


def folder_tree(spark: SparkSession, path: str) -> DataFrame:
    """path, size and extension of all files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), extension(F.element_at(F.split("path", "/"), -1)).alias("ext"))


def is_dicom(content: Column) -> Column:
    """Whether bytes 128 to 131 spell DICM."""
    return F.substring(content, 129, 4) == F.lit(b"DICM")


def unzip(archives: DataFrame) -> DataFrame:
    """path, entry, size and content of the files in archives (path, content).

    Sub-folders stay in the entry's name; entries with absolute or upward paths and program files are
    left out; a broken archive gives no rows.
    """

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for info in archive.infolist():
                    parts = info.filename.replace("\\", "/").split("/")
                    if info.is_dir() or ".." in parts or parts[0] in ("", "~") or info.filename.lower().endswith(UNSAFE_EXT):
                        continue
                    data = archive.read(info)
                    yield pd.DataFrame({"path": [path], "entry": ["/".join(parts)], "size": [len(data)], "content": [data]})

    return archives.select("path", "content").mapInPandas(expand, "path string, entry string, size long, content binary")
