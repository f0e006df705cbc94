"""Tables that change together: a batch that breaks off in between is not seen, and is whole after it runs again."""

import pytest
from pyspark.sql import functions as F

from serieslab.streaming import commit, ingest

ROW = "path string, sha1 string, part int, lab string, date date, name string, doc string, tests array<struct<name:string,value:double,unit:string>>"


def rows(spark, found):
    frame = spark.createDataFrame([(p, h, part, lab, name, doc, [("t", float(i), "u") for i in range(n)]) for p, h, part, lab, name, doc, n in found], ROW.replace("date date, ", ""))
    return frame.withColumn("date", F.lit("2024-01-01").cast("date"))


FIRST = [("a", "h1", 0, "L", "ANA PEREZ GIL", "111111", 2), ("b", "h1", 0, "L", "ANA PEREZ GIL", "111111", 2), ("c", "h2", 0, "L", "EVA RUIZ", None, 1), ("d", "h3", 0, None, None, None, 0)]
SECOND = [("e", "h1", 0, "L", "ANA PEREZ GIL", "111111", 2), ("f", "h4", 0, "M", "ANA PEREZ GIL", "", 3), ("f", "h4", 1, "N", None, None, 1), ("g", "h5", 0, "L", "LUIS CANO", "222222", 1), ("c", "h2", 0, "L", "EVA RUIZ", None, 1)]


def state(tables, number=None):
    folders = tables.list_of(tables.newest() if number is None else number) or {}
    return {t: sorted(map(str, tables.read(t, folders).collect())) for t in commit.TABLES}


@pytest.mark.parametrize("breaks", [3])
def test_a_batch_that_breaks_off(spark, tmp_path, monkeypatch, breaks):
    whole, torn = (commit.Tables(spark, f"file://{tmp_path}/{n}", commit.TABLES) for n in ("whole", "torn"))
    for tables in (whole, torn):
        commit.ingest_batch(tables, rows(spark, FIRST), 0)
    before, write, done = state(torn), commit.Tables._write, []

    def fails(self, frame, folder):
        if len(done) == breaks:
            raise OSError("lost")
        done.append(folder)
        write(self, frame, folder)

    monkeypatch.setattr(commit.Tables, "_write", fails)
    with pytest.raises(OSError, match="lost"):
        commit.ingest_batch(torn, rows(spark, SECOND), 1)
    assert state(torn) == before and torn.newest() == 0
    monkeypatch.setattr(commit.Tables, "_write", write)
    for _ in range(2):  # the second time is a repeated delivery
        commit.ingest_batch(torn, rows(spark, SECOND), 1)
    commit.ingest_batch(whole, rows(spark, SECOND), 1)
    assert state(torn) == state(whole)
    assert {t: len(r) for t, r in state(torn).items()} == {"persons": 2, "reports": 4, "tests": 7, "files": 7, "pending": 1}
    assert state(torn, 0) == before


def test_many_batches_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commit, "FOLDERS", 2)
    tables = commit.Tables(spark, f"file://{tmp_path}", {"t": "i long"})
    for i in range(5):
        tables.commit(i, tables.list_of(i - 1) or {}, {"t": spark.range(i, i + 1).select(F.col("id").alias("i"))})
    assert sorted(r.i for r in tables.read("t").collect()) == list(range(5)) and len(tables.list_of(4)["t"]) <= 2
    tables.commit(5, tables.list_of(4), {}, {"t": spark.range(9, 10).select(F.col("id").alias("i"))})
    assert [r.i for r in tables.read("t").collect()] == [9]
    assert commit.Tables(spark, f"file://{tmp_path}/none", {"t": "i long"}).read("t").count() == 0


def test_stream(spark, tmp_path):
    for part in (FIRST, SECOND):
        rows(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.poll(spark, str(tmp_path / "in"), rows(spark, FIRST).schema, per_batch=1)
    for _ in range(2):
        commit.ingest_stream(stream, f"file://{tmp_path}/tables", str(tmp_path / "state")).awaitTermination()
    tables = commit.Tables(spark, f"file://{tmp_path}/tables", commit.TABLES)
    assert tables.newest() == 1 and len(state(tables)["files"]) == 7 and len(state(tables)["tests"]) == 7
