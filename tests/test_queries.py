"""Every registered query of the core against its SQL in DuckDB, over sf0.001."""

import math

import duckdb
import pytest

from serieslab import queries

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for n in NAMES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{sf}/{n}.parquet')")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "NULL"
    if isinstance(x, int | float) and not isinstance(x, bool):
        return f"{float(x):.9g}"
    if isinstance(x, list | tuple):
        return str([plain(y) for y in x])
    return str(x)


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf, con, name):
    got = queries.queries()[name](spark, sf)
    sql = queries.oracle_sql()[name]
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rounded_limit(spark, tmp_path):
    """Differences that are rounded down to the limit are within it, those that are rounded up are not."""
    vectors = [(0, [0.0] * 64), (1, [0.14000045] * 64), (2, [-0.14000055] * 64)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in queries.queries()["pairwise_signature_diff"](spark, str(tmp_path)).collect()] == [(0, 0, 1, 0.14)]


def test_stream_of_many_files(spark, tmp_path, monkeypatch):
    """Documents in many files come as many files in two batches, none written by a single task, with the same tables."""
    from serieslab.queries import streams

    monkeypatch.setattr(streams, "shared_folder", lambda _: str(tmp_path / "shared"))
    texts = [(i, "x" * (i % 7 + 1)) for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.name: r.n for r in queries.queries()["ingest_stream_tables"](spark, str(tmp_path)).collect()}
    assert got == {"files": 40, "reports": 3, "persons": 3, "tests": 6, "pending": 4}
    assert len(list(tmp_path.glob("shared/ingest-*/in/*.parquet"))) > 2
    assert len(list(tmp_path.glob("shared/ingest-*/tables/lists/*.json"))) == 2


@pytest.mark.parametrize("name", ["alias_of_catalogue", "longest_of_catalogue"])
def test_catalogue_is_read_once(spark, sf, name):
    """The words of all texts are taken out once; what is looked up in them starts from stored words."""
    found = queries.queries()[name](spark, sf)
    assert found.inputFiles() and not [f for f in found.inputFiles() if "documents" in f or "conversations" in f]


@pytest.mark.parametrize("name", ["drug_drug_pairs", "drug_lab_checks", "unknown_items"])
def test_medicines_are_made_once(spark, sf, name):
    """The list of medicines is stored before its names are looked up."""
    found = queries.queries()[name](spark, sf)
    assert not [f for f in found.inputFiles() if "lineitem" in f or "orders" in f]
