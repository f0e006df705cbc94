"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that reaches Python tasks comes in batches of about this many bytes.
BATCH_BYTES = 4 << 20
_LOCAL_MASTER, _own_folder = re.compile(r"local(\[|$)"), []
#: Where the tables of :func:`materialise` lie.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Only where a session on one machine has no such setting (tests) a temporary folder is used, which goes
    at exit; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _LOCAL_MASTER.match(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="spark-"))
            atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
        base = _own_folder[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, instead_of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: later steps start from files.

    Tables of ``instead_of``, results of this function or of :func:`keep` that nothing reads any more,
    are dropped then.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    for old in instead_of:
        if old in _paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop(old))
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        else:
            old.unpersist()
    return out


def folder_of(df: DataFrame) -> str:
    """Where the table of :func:`materialise` lies."""
    return _paths[df]


class Blocks:
    """Rows of a table by its column ``block``, as tasks need them: only row groups with the block are read.

    The table, written by :func:`materialise` in the order of its blocks, may be of any size, as a task
    looks up the blocks of its own rows; the last few stay in memory.
    """

    def __init__(self, folder: str, most: int = 4) -> None:
        system, path = fs.FileSystem.from_uri(folder)
        self.table = dataset.dataset(path, filesystem=system, format="parquet")
        self.most, self.found = most, {}

    def of(self, block: int, make: Callable[[pa.Table], object]) -> object:
        """What ``make`` gives for the rows of the block."""
        if block not in self.found:
            if len(self.found) >= self.most:
                del self.found[next(iter(self.found))]
            self.found[block] = make(self.table.to_table(filter=dataset.field("block") == block))
        return self.found[block]


def by_block(df: DataFrame, name: str, instead_of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """:func:`materialise` in the order of the column ``block``, for :class:`Blocks`."""
    return materialise(df.repartitionByRange("block").sortWithinPartitions("block"), name, instead_of)


def keep(df: DataFrame) -> DataFrame:
    """``df``, kept on the executors' disks once it is computed.

    For small tables that one step reads several times: no files are written, and what a lost executor
    held is computed again from the tables before. Plans still hold what they were made of, so chains
    of steps are cut by :func:`materialise`.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def give_back() -> None:
    """Return free memory of a worker process to the system: workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def driver_gives_back(spark: SparkSession) -> None:
    """Return free memory of the driver to the system, of its Python and of its JVM, whose heap else stays as large as an earlier step made it."""
    give_back()
    spark._jvm.java.lang.System.gc()


def joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in order, in batches of up to about ``most`` bytes: what one batch costs whatever its size is paid less often."""
    found, size = [], 0
    for batch in batches:
        if found and size + batch.nbytes > most:
            yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]
            found, size = [], 0
        if batch.num_rows:
            found.append(batch)
            size += batch.nbytes
    if found:
        yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, most: int = BATCH_BYTES) -> DataFrame:
    """``mapInArrow`` batch by batch; ``make`` runs once in a task and returns the function of a batch.

    Batches are bounded by bytes as well as by rows, so a run of very long texts stays small; the bound is
    a setting that Spark reads when it plans, so the session has it from here on. With a larger ``most``
    batches are :func:`joined` before the function gets them.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches if most <= BATCH_BYTES else joined(batches, most):
            if batch.num_rows:
                yield fn(batch)
        give_back()

    return df.mapInArrow(run, schema)


def row_id(column: str | None = None) -> Column:
    """A number for each row of a scan, the same when a lost task runs again over the same files; or the column that has it."""
    return F.col(column) if column else F.monotonically_increasing_id()


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no column of the frames has it, whatever its case."""
    used = {c.lower() for df in frames for c in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``df`` (all, if None) with a number of each row, the same whenever it is read, in the column ``name``.

    ``name`` may not be one of them (see :func:`fresh`); what other columns are called doesn't matter.
    Rows of Parquet files are numbered by file and place, however the files are split; others are written.
    """
    columns = df.columns if columns is None else columns
    if df._jdf.queryExecution().analyzed().children().isEmpty() and df.inputFiles():
        hidden = df.metadataColumn("_metadata")  # also where a column of the files is called so
        paths = sorted(r[0] for r in df.select(hidden["file_path"]).distinct().collect())
        path, number, place = (fresh(c, df) for c in ("path_", "number_", "place_"))
        numbers = df.sparkSession.createDataFrame(list(enumerate(paths)), f"`{number}` long, `{path}` string")
        placed = df.select(*(df[quoted(c)] for c in columns), hidden["file_path"].alias(path), hidden["row_index"].alias(place)).join(F.broadcast(numbers), path)
        return placed.select(*map(quoted, columns), (F.shiftleft(number, 40) + F.col(place)).alias(name))
    return materialise(df.select(*map(quoted, columns)).withColumn(name, row_id()), "numbered")


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (splitmix64 finaliser) over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
