"""Several tables that change together: a batch of a stream is in all of them or in none."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from serieslab.plans import ingest
from serieslab.session import stored

#: Folders of a table after which a batch writes it anew as one.
FOLDERS = 64
# The tables of an ingest and their columns.
TABLES = {
    "persons": "id long, name string, doc string",
    "reports": "key string, person_id long, file_hash string, part int, lab string, date date",
    "tests": "key string, name string, value double, unit string",
    "files": "path string, sha1 string",
    "pending": "key string, patient_name string, doc string, lab string, date date",
}


class Tables:
    """Tables in one folder and the list of what each consists of, of which there is a version for each batch.

    A batch writes its rows to folders of its own and then, last and at once, the list that names
    them: until then readers see the tables as they were. A batch that is run again writes over its own folders,
    which no list names, and starts from the list before it; one whose list is there already changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]) -> None:
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas
        self.files = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def list_of(self, number: int) -> dict[str, list[str]] | None:
        """Folders of each table after a batch, None if that batch is not in."""
        at = self._at(f"lists/{number}.json")
        if not self.files.exists(at):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/lists/{number}.json", wholetext=True).first()[0])

    def newest(self) -> int:
        """The last batch that is in, -1 if there is none."""
        at = self._at("lists")
        if not self.files.exists(at):
            return -1
        names = [s.getPath().getName() for s in self.files.listStatus(at)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=-1)

    def read(self, table: str, folders: dict[str, list[str]] | None = None) -> DataFrame:
        """A table as of a list, the newest one by default; empty before the first batch."""
        if folders is None:
            folders = self.list_of(self.newest()) or {}
        own = [f"{self.path}/{f}" for f in folders.get(table, [])]
        reader = self.spark.read.schema(self.schemas[table])
        return reader.parquet(*own) if own else self.spark.createDataFrame([], self.schemas[table])

    def commit(self, number: int, before: dict[str, list[str]], added: dict[str, DataFrame], replaced: dict[str, DataFrame] | None = None) -> None:
        """Write a batch's rows (``added`` to tables or in place of them) and the list that has them."""
        after = dict(before)
        for table, rows in [*added.items(), *(replaced or {}).items()]:
            folder, own = f"data/{table}/{number}", before.get(table, [])
            anew = table in (replaced or {}) or len(own) >= FOLDERS
            if anew and table in added:
                rows = self.read(table, before).unionByName(rows.select(*self._columns(table)))
            self._write(rows.select(*self._columns(table)), folder)
            after[table] = [folder] if anew else [*own, folder]
        draft, final = self._at(f"lists/.{number}"), self._at(f"lists/{number}.json")
        out = self.files.create(draft, True)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        if not self.files.rename(draft, final):
            raise OSError(f"{final} could not be written")

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{folder}")

    def _columns(self, table: str) -> list[str]:
        return [c.strip().split(" ")[0] for c in self.schemas[table].split(",")]


def ingest_batch(tables: Tables, batch: DataFrame, number: int) -> None:
    """Files of a batch with the reports read from them (path, sha1, part, lab, date, name, doc, tests) into the tables of an ingest.

    Files are registered; reports that are new go to reports and tests with their person, who is made if
    unknown, or to pending if nobody can be told (:func:`ingest.ingest_flow`). ``part`` numbers the
    reports of a file; tests are structs of name, value and unit. A file without a report has a null lab.
    """
    if tables.list_of(number) is not None:
        return
    before = tables.list_of(number - 1) or {}
    held = stored(batch, "batch")
    files = held.select("path", "sha1").distinct()
    reports = held.filter("lab is not null").groupBy("sha1", "part").agg(F.min_by(F.struct("lab", "date", "name", "doc", "tests"), "path").alias("r"), F.min("path").alias("seq"))
    reports = stored(reports.select(F.col("sha1").alias("file_hash"), "part", "r.lab", "r.date", "r.name", "r.doc", "seq", "r.tests"), "read-reports")
    registry, persons, known = (tables.read(t, before) for t in ("files", "persons", "reports"))
    flow = ingest.ingest_flow(files, registry, reports.drop("tests"), persons, known)
    new = stored(flow["stored"], "new-reports")
    own = reports.select(F.col("file_hash").alias("h"), F.col("part").alias("p"), "tests")
    tests = new.join(own, (F.col("file_hash") == F.col("h")) & (F.col("part") == F.col("p"))).select("key", F.inline("tests"))
    waiting = flow["pending"].join(tables.read("pending", before).select("key"), "key", "left_anti")
    made = new.filter("created").groupBy(F.col("person_id").alias("id")).agg(F.min("name").alias("name"), F.min("doc").alias("doc"))
    fresh = files.join(registry.select("path"), "path", "left_anti")
    tables.commit(number, before, {"persons": made, "reports": new, "tests": tests, "files": fresh, "pending": waiting})


def ingest_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run :func:`ingest_batch` over a stream; what is delivered again, after a crash or by the source, is in once."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        ingest_batch(Tables(spark, path, TABLES), batch, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
