"""Folds, write statements, sources and streams."""

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from serieslab import schema
from serieslab.operators import containment, dedup, dml, joins, series
from serieslab.session import stored
from serieslab.sources import files
from serieslab.streaming import ingest


def test_keep_unlike_last(spark):
    rows = [("g", i, [x] if x is not None else None) for i, x in enumerate([0.0, 0.06, 0.12, 0.18, None, 0.18])]
    df = spark.createDataFrame(rows, "g string, i int, s array<float>")
    assert sorted(r.i for r in dedup.keep_unlike_last(df, "g", "i", "s", 0.10).collect()) == [0, 2, 4, 5]


def test_greedy_chunks(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate([50, 30, 20, 100, 10])], "g string, i int, n int")
    assert [r.chunk for r in dedup.greedy_chunks(df, "g", "i", "n", 90).orderBy("i").collect()] == [0, 0, 1, 2, 3]


def test_file_status(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "3"), ("e", "3"), ("f", ""), ("g", "")], "path string, sha1 string")
    known = spark.createDataFrame([("a", "1"), ("x", "2")], "path string, sha1 string")
    got = {r.path: r.status for r in dedup.file_status(new, known).collect()}
    assert got == {"a": "unchanged", "b": "duplicate", "c": "duplicate", "d": "new", "e": "duplicate", "f": "new", "g": "new"}


def test_write_statements(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "", 0)], "id long, v string, seq int")
    new = spark.createDataFrame([(2, "b", 1), (3, "c", 1), (3, "d", 2)], "id long, v string, seq int")
    assert {r.id: r.v for r in dml.upsert(base, new, ["id"], "seq").collect()} == {1: "a", 2: "b", 3: "d"}
    assert {r.id: r.v for r in dml.insert_or_ignore(base, new, ["id"], F.col("seq")).collect()} == {1: "a", 2: "", 3: "c"}
    assert {r.id: r.v for r in dml.fill_missing(base, new.filter("seq = 1"), "id", ["v"]).collect()} == {1: "a", 2: "b"}
    moved = dml.transfer_unique(spark.createDataFrame([(1, "m", 1, "x"), (2, "m", 2, "y"), (1, "k", 1, "z")], "p long, model string, seq int, c string"), "p", 1, 2, ["p", "model"], "seq")
    assert sorted((r.p, r.model, r.c) for r in moved.collect()) == [(2, "k", "z"), (2, "m", "y")]
    twice = dml.backfill(dml.backfill(base.limit(0), new, ["id"]), new, ["id"])
    assert twice.count() == 0


def test_conform(spark):
    got = dml.conform(spark.createDataFrame([(1, "A", "x")], "id int, name string, other string"), schema.PERSONS)
    assert got.schema == schema.PERSONS and dml.conform(got, schema.PERSONS).collect() == got.collect()


def test_stale(spark):
    df = spark.sql("select * from values (1, 2, 1), (2, 1, 2), (3, null, null), (4, null, 1), (5, 1, null) t(i, newest, last)")
    assert sorted(r.i for r in df.filter(dml.is_stale(F.col("newest"), F.col("last"))).collect()) == [1, 3, 5]


def test_longest_contained(spark):
    dim = spark.createDataFrame([(0, "abc", "x"), (1, "abcd", "y"), (2, "bcda", "z"), (3, "ab", "w")], "ord int, word string, code string")
    texts = spark.createDataFrame([("abcda",), ("ab",), ("q",), (None,)], "t string")
    for few in (0, 100):  # by automata and by broadcast
        got = joins.longest_contained(texts, "t", dim, "word", "code", few=few)
        assert {r.t: r.match for r in got.collect()} == {"abcda": "y", "ab": "w", "q": None, None: None}


@pytest.mark.parametrize("most, part", [(1 << 20, 1 << 20), (200, 300), (40, 50)])
@pytest.mark.parametrize("longest", [False, True])
def test_contained_by_automata(spark, most, part, longest):
    """One automaton, shards by first character, and characters with more words than a shard holds."""
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("aaabñ😀 ") for _ in range(rng.randint(1, n)))
    texts, words = [make(30) for _ in range(200)], sorted({make(5) for _ in range(150)})
    frame = spark.createDataFrame([(t,) for t in [*texts, None, "", texts[0]]], "t string")
    got = [tuple(r) for r in containment.contained(frame, "t", spark.createDataFrame([(w,) for w in [*words, None, "", words[0]]], "w string"), "w", longest, most, part).collect()]
    want = {(t, w) for t in texts for w in words if w in t}
    assert len(got) == len(set(got)) and set(got) <= want
    if longest:
        best = {t: max(len(w) for u, w in want if u == t) for t, _ in want}
        assert {(t, w) for t, w in got if len(w) == best[t]} == {(t, w) for t, w in want if len(w) == best[t]}
    else:
        assert set(got) == want
    none = spark.createDataFrame([], "w string")
    assert containment.contained(frame, "t", none, "w").count() == containment.contained(none, "w", frame, "t", False, most, part).count() == 0


def test_catalogue_of_many_names(spark, sf):
    """200,000 names and the names of parts: no nested loop in the plan, the same as looking for each piece."""
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name")
    own = spark.range(200_000).select(F.concat(F.lit("name "), F.col("id").cast("string")).alias("word"), F.col("id").alias("ord"))
    real = parts.select(F.explode(F.split("p_name", " ")).alias("word")).distinct().select("word", F.xxhash64("word").alias("ord"))
    dim = own.unionByName(real)
    out = joins.longest_contained(parts, "p_name", dim, "word", "word")
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    for r in out.collect():
        assert len(r.match) == max(map(len, r.p_name.split(" ")))


def test_pieces_of_short_texts(spark):
    """Among many words, pieces of short texts are joined without Python; texts of any length lose no word, rows keep their number."""
    rng = random.Random(2)
    make = lambda least, n: "".join(rng.choice("aaabñ😀 ") for _ in range(rng.randint(least, n)))
    short, long = [make(0, joins.SHORT) for _ in range(60)] + ["ab" * (joins.SHORT // 2)], [make(joins.SHORT + 1, 90) for _ in range(20)] + ["ba" * 300]
    words = [make(2, 5) for _ in range(60)] + ["ab" * 12, "ab" * 20]
    dim = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, ord int")
    for texts in (short, short + long):
        frame = spark.createDataFrame([(t, i) for i, t in enumerate([*texts, None])], "t string, n int")
        got = joins.containing(frame, "t", dim, "w", few=0)
        assert sorted((r.n, r.ord) for r in got.collect()) == [(n, i) for n, t in enumerate(texts) for i, w in enumerate(words) if w in t]
        assert ("Arrow" in got._jdf.queryExecution().toString()) == (texts != short)


def test_many_words_are_not_broadcast(spark):
    """Names looked up among 60,000 are shuffled: their files are small, but what the driver would hold of their pieces isn't."""
    names = stored(spark.range(60_000).select(F.concat(F.lit("name "), F.col("id").cast("string")).alias("name")), "names")
    dim = stored(names.select(F.col("name").alias("alias"), F.col("name").alias("word"), F.struct(F.length("name").alias("n"), "name").alias("ord")), "aliases")
    for found in (joins.resolve_alias(names, "name", dim, "alias"), joins.longest_contained(names, "name", dim, "word", "word")):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.filter("match = name").count() == 60_000


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_first_alias_among_many(spark, monkeypatch, sent):
    """Equal aliases come first, then the first that contains the name or is contained in it, among texts of any length."""
    monkeypatch.setattr(joins, "SENT", sent)
    rng = random.Random(3)
    make = lambda least, n: "".join(rng.choice("aaabñ😀 ") for _ in range(rng.randint(least, n)))
    names = [make(1, 9) for _ in range(80)] + [make(joins.SHORT + 1, 60) for _ in range(10)] + ["q", "ab" * joins.SHORT, "", None]
    words = [make(1, 9) for _ in range(60)] + [make(joins.SHORT + 1, 60) for _ in range(10)] + ["ab" * joins.SHORT, names[0], names[0], "", None]
    aliases = [(w, o, f"r{o}") for o, w in zip(rng.sample(range(999), len(words)), words, strict=True)]
    frame = spark.createDataFrame([(t, i) for i, t in enumerate(names)], "t string, n int")

    def want(t):
        near = lambda w: len(w) >= 3 and (w in t or t in w)
        found = [(w != t, o, r) for w, o, r in aliases if t and w and (w == t or near(w))]
        return min(found)[2] if found else None

    for few in (0, 1_000):
        got = joins.resolve_alias(frame, "t", spark.createDataFrame(aliases, "alias string, ord int, r string"), "r", least=3, few=few)
        assert {r.n: r.match for r in got.collect()} == {i: want(t) for i, t in enumerate(names)}


def test_resolve_alias(spark):
    aliases = spark.createDataFrame([(0, "losartan", "x"), (1, "losartan potasico", "y"), (2, "aas", "z"), (3, "vitamina d", "w")], "ord int, alias string, code string")
    names = spark.createDataFrame([("losartan potasico",), ("losartan 50",), ("potasico",), ("aas 100",), ("aas",), ("",), (None,)], "name string")
    for few in (0, 100):
        got = {r.name: r.match for r in joins.resolve_alias(names, "name", aliases, "code", few=few).collect()}
        assert got == {"losartan potasico": "y", "losartan 50": "x", "potasico": "y", "aas 100": None, "aas": "z", "": None, None: None}


def test_picks_and_blocks(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0), ("b", 1), ("c", 9)], "g string, i int")
    got = {}
    for r in series.first_middle_last(df, ["g"], F.col("i")).collect():
        got.setdefault(r.g, set()).add(r.i)
    assert got == {"a": {0, 2, 4}, "b": {0, 1}, "c": {9}}
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate("xHabHc")], "doc string, pos int, line string")
    assert [r.block for r in series.blocks(lines, "doc", ["pos"], F.col("line") == "H").orderBy("pos").collect()] == [0, 1, 1, 1, 2, 2]


def test_folder_and_archives(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in ("sub/a.txt", "../up.txt", "/abs.txt", "run.exe"):
            z.writestr(name, "hello")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.zip").write_bytes(data.getvalue())
    (tmp_path / "in/y.zip").write_bytes(b"broken")
    (tmp_path / "in/z.pdf").write_bytes(b"0" * 128 + b"DICM")
    archives = files.scan_folder(spark, str(tmp_path / "in"), "*.zip", content=True)
    assert [(r.entry, r.size) for r in files.unzip(archives).collect()] == [("sub/a.txt", 5)]
    assert sorted(r.ext for r in files.folder_tree(spark, str(tmp_path / "in")).collect()) == [".pdf", ".zip", ".zip"]
    assert files.scan_folder(spark, str(tmp_path / "in"), content=True).filter(files.is_dicom(F.col("content"))).count() == 1


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.tumbling(ingest.event_time(ingest.poll(spark, str(tmp_path / "in"), events.schema, 1), "ts", "60 days"), "ts", "1 day", "event_type")
    query = stream.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = ingest.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "event_type")
    rows = lambda df: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert rows(spark.table("daily")) == rows(batch)


def test_upsert_stream(spark, tmp_path):
    kind = "id long, v string, seq int"
    path = lambda x: str(tmp_path / x)
    for rows in ([(1, "a", 1), (2, "b", 1)], [(1, "c", 2)], [(1, "old", 0), (3, "d", 1)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path("in"))
        source = ingest.poll(spark, path("in"), spark.createDataFrame([], kind).schema)
        ingest.upsert_sink(source, path("out"), path("state"), ["id"], "seq").awaitTermination()
    schema = spark.createDataFrame([], kind).schema
    assert {r.id: r.v for r in ingest.latest(spark, path("out"), schema).collect()} == {1: "c", 2: "b", 3: "d"}
    for i in range(5):  # versions that nothing names are gone
        spark.createDataFrame([(1, f"n{i}", 9 + i)], kind).coalesce(1).write.mode("append").parquet(path("in"))
        ingest.upsert_sink(ingest.poll(spark, path("in"), schema), path("out"), path("state"), ["id"], "seq").awaitTermination()
    assert {r.id: r.v for r in ingest.latest(spark, path("out"), schema).collect()} == {1: "n4", 2: "b", 3: "d"}
    assert len([p for p in (tmp_path / "out/data").glob("*/_bucket=*")]) <= 5


def test_zip_chunks(spark):
    from serieslab.sources.sinks import zip_chunks

    rows = [("s", f"f{i}.bin", bytes(n)) for i, n in enumerate([50, 30, 20, 100, 10])]
    got = zip_chunks(spark.createDataFrame(rows, "study string, name string, content binary"), 90).orderBy("chunk").collect()
    assert [zipfile.ZipFile(io.BytesIO(r.content)).namelist() for r in got] == [["f0.bin", "f1.bin"], ["f2.bin"], ["f3.bin"], ["f4.bin"]]


def test_crawl(spark, tmp_path):
    from serieslab.sources import crawl, registry

    for i in (1, 2):
        (tmp_path / f"p{i}.html").write_text(f'<a href="/m/{i}">x</a><a href="/m/{i}">y</a>')
    crawl.register(spark)
    pages = spark.read.format("paged").option("url", f"file://{tmp_path}/p{{page}}.html").option("pages", 4).option("backOff", 0).load()
    assert sorted((r.page, r.href) for r in registry.page_links(pages.filter("html is not null"), "page", "html").collect()) == [(1, "/m/1"), (2, "/m/2")]
    assert {r.page for r in pages.filter("error like '%Error%'").collect()} == {3, 4}
    for i in (4, 5, 6, 7):
        (tmp_path / f"p{i}.html").write_text("<p>none</p>" if i > 5 else '<a href="/m">x</a>')
    got = crawl.crawl(spark, f"file://{tmp_path}/p{{page}}.html", str(tmp_path / "table"), ~F.col("html").contains("<a"), wave=3, backOff=0).collect()
    assert sorted((r.page, r.html is None) for r in got) == [(1, False), (2, False), (3, True), (4, False), (5, False)]  # 3 failed, 6 is empty


def test_dicom_tags(spark):
    from serieslab.sources import dicom

    def element(group, number, kind, value):
        value += b" " * (len(value) % 2)
        head = group.to_bytes(2, "little") + number.to_bytes(2, "little") + kind
        return head + (b"\0\0" + len(value).to_bytes(4, "little") if kind == b"OW" else len(value).to_bytes(2, "little")) + value

    unknown = b"\x08\0\x40\x11SQ\0\0\xff\xff\xff\xff" + b"\xfe\xff\0\xe0\xff\xff\xff\xff" + element(8, 0x1150, b"UI", b"1.2") + b"\xfe\xff\x0d\xe0\0\0\0\0" + b"\xfe\xff\xdd\xe0\0\0\0\0"
    long = element(0x20, 0x4000, b"LT", b"y" * 600)
    data = b"\0" * 128 + b"DICM" + element(2, 0x10, b"UI", b"1.2.840.10008.1.2.1") + element(8, 0x60, b"CS", b"MR") + element(0x28, 0x10, b"US", (512).to_bytes(2, "little")) + unknown + long + element(0x7FE0, 0x10, b"OW", b"x" * 400)
    got = dicom.read_tags(spark.createDataFrame([("a", data), ("b", b"nothing")], "path string, content binary")).collect()
    assert {(r.path, r.tag, r.value) for r in got} == {("a", "00020010", "1.2.840.10008.1.2.1"), ("a", "00080060", "MR"), ("a", "00280010", "512"), ("a", "00204000", "y" * 600)}


def test_sql_functions(spark):
    from serieslab.functions import sql

    sql.register(spark)
    r = spark.sql("SELECT norm_text('Glucósa (Ayunas)') AS n, flag_of(5, 6, 9) AS f, status_of(5, 6, 9) AS s, trend_of(2, 1) AS t, range_meter(85, 70, 100) AS m").first()
    assert tuple(r) == ("glucosa ayunas", "L", "bajo", "subiendo", 50.0)
    assert [tuple(x) for x in spark.sql("SELECT * FROM extract_strengths('X 50 mg + 10 ml / 5 UI')").collect()] == [("50", "mg"), ("5", "UI")]
    assert [x.id for x in spark.sql("SELECT * FROM extract_ids('1234567 y 12 y 1234567 y 654321')").collect()] == ["1234567", "654321"]


def test_idle_flush(spark, tmp_path):
    rows = [("a", 0), ("a", 60), ("b", 30), ("c", 5000), ("a", 5001)]
    events = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    for i, part in enumerate((events.filter("unix_seconds(ts) < 1700000100"), events.filter("k = 'c'"), events.filter("unix_seconds(ts) = 1700005001"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = ingest.idle_flush(source, "k", "ts", 180).writeStream.format("memory").queryName("flushed").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.k, r.n) for r in spark.table("flushed").collect()) == [("a", 2), ("b", 1)]


def test_locale_order(spark):
    df = spark.createDataFrame([("Zinc",), ("ácido",), ("Azúcar",), ("albúmina",)], "t string")
    assert [r.t for r in df.orderBy(series.locale_order(F.col("t"))).collect()] == ["ácido", "albúmina", "Azúcar", "Zinc"]


def test_carry_patient(spark):
    from serieslab.plans.ingest import carry_patient

    rows = [("h", 1, "2024", "Ana", "1"), ("h", 2, None, None, None), ("h", 3, "2025", "Eva", None)]
    got = carry_patient(spark.createDataFrame(rows, "file_hash string, part int, date string, name string, doc string")).orderBy("part").collect()
    assert [(r.date, r["name"], r.doc) for r in got] == [("2024", "Ana", "1"), ("2024", "Ana", "1"), ("2025", "Eva", "1")]


def test_percentiles(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=1001), "b": np.full(7, 3.0), "c": np.array([5.0]), "d": np.array([1e9, *range(400)], float), "e": rng.integers(0, 4, 999).astype(float)}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None)], "g string, x double")
    got = {r.g: r.percentiles for r in dedup.percentiles(df, "g", "x", [0.0, 0.005, 0.5, 0.995, 1.0], bins=16).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        assert got[g] == pytest.approx(np.quantile(xs, [0.0, 0.005, 0.5, 0.995, 1.0]).tolist())


def test_row_numbers(spark):
    from serieslab.operators.series import row_numbers

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    assert [r.n for r in row_numbers(df, "n", "k").orderBy("k").collect()] == list(range(1, 1001))
    assert row_numbers(df.limit(0), "n", "k").count() == 0


def test_persons_of_one_name(spark):
    """Of many persons with one name one row meets the names that are looked for, and the smallest id is found."""
    known = spark.range(1, 401).select("id", F.lit("Ana Peña Núñez").alias("name"), F.lit("").alias("doc")).unionByName(spark.createDataFrame([(0, None, ""), (500, "ANA NUNEZ PENA DIAZ", "7")], "id long, name string, doc string"))
    people = spark.createDataFrame([("ANA PEÑA NÚÑEZ", ""), ("Ana Diaz Pena Nunez", ""), ("x", "7"), (None, "")], "name string, doc string")
    found = joins.fuzzy_person(people, known)
    assert {r.name: r.match_id for r in found.collect()} == {"ANA PEÑA NÚÑEZ": 1, "Ana Diaz Pena Nunez": 1, "x": 500, None: None}
    assert "min(id" in found._jdf.queryExecution().optimizedPlan().toString().split("Generate")[-1]


def test_monthly_pivot(spark):
    """A group holds its own months only; one without a month, or with months that are not asked for, is a row of nulls."""
    rows = [(1, "2024-01", 5.0), (1, "2024-03", None), (2, None, 1.0), (3, "1999-01", 2.0), (None, "2024-02", 7.0)]
    got = series.monthly_pivot(spark.createDataFrame(rows, "k int, month string, value double"), "k", ["2024-01", "2024-02", "2024-03"])
    assert {r.k: tuple(r)[1:] for r in got.collect()} == {1: (5.0, None, None), 2: (None,) * 3, 3: (None,) * 3, None: (None, 7.0, None)}
    assert "pivotfirst" not in got._jdf.queryExecution().toString().lower()
