"""The registered queries over whole tables: against SQL, plain versions, or held-out accuracy."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from serieslab.llm import oracles, queries
from serieslab.llm.mix import capped_targets
from tests.llm.helpers import SCHEMA, words
from tests.llm.test_operators import TOKENIZER, plain_components, plain_hits
from tests.test_queries import NAMES, rows


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for n in NAMES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{sf}/{n}.parquet')")
    return c


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def run(spark, sf, name):
    return queries.queries()[name](spark, sf)


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(oracles.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_sql(spark, sf, con, name):
    got, want = run(spark, sf, name), con.execute(oracles.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), columns)


def test_lm(spark, sf, documents):
    got = {r.doc_id: r for r in run(spark, sf, "op3_lm_score").collect()}
    held = {i for i, *_ in documents if zlib.crc32(str(i).encode()) % 10 == 0}
    counts = Counter(w for i, t, *_ in documents if i not in held for w in [*words(t), None])
    total, kinds = sum(counts.values()), len(counts)
    for i, t, *_ in documents:
        own = [*words(t), None]
        base = sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)


def test_lm_held_out(spark):
    """The model against the base on documents that neither has seen, by at least 0.15 log10 a token."""
    got = [r for r in run(spark, "/root/testdata/sf0.1", "op3_lm_score").select("held_out", "n_tokens", "base_score", "score").collect() if r.held_out]
    tokens = sum(r.n_tokens for r in got)
    assert len(got) > 900 and all(r.score < 0 for r in got)
    assert sum(r.score for r in got) / tokens > sum(r.base_score for r in got) / tokens + 0.15


def test_near(spark, sf, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, sf, "op4_near_dedup").collect()}
    assert got == plain_components(documents, 4)


def test_mix(spark, sf, documents):
    got, source = run(spark, sf, "op5_mix").collect(), {i: s for i, _, _, s, _ in documents}
    assert sum({source[r.doc_id]: r.target for r in got}.values()) == pytest.approx(sum(r["size"] for r in got))
    assert all(r.taken in {k * r["size"] for k in range(4)} for r in got)


def test_accuracy(spark, sf, documents):
    lang = {i: g for i, _, g, *_ in documents}
    got = run(spark, sf, "op7_language").collect()
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.97


def test_toxicity_held_out(spark):
    """On documents that were not learnt from, at the size where they hold some hundred toxic ones."""
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = run(spark, sf, "op10_toxicity").select("doc_id", "held_out", "predicted", F.size("evidence").alias("n"), "score").collect()
    assert len(found) == 10_000 and np.mean([r.n == 25 for r in found]) > 0.99
    held = [r for r in found if r.held_out and r.doc_id in toxic]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in found)
    assert np.mean([r.predicted for r in held if toxic[r.doc_id] == 1]) >= 0.9
    assert np.mean([r.predicted for r in held if toxic[r.doc_id] == 0]) <= 0.02


def test_tokens(spark, sf, documents):
    whole, start = Tokenizer.from_file(TOKENIZER), 0
    got = sorted(run(spark, sf, "op8_tokens").collect(), key=lambda r: r.doc_id)
    for r, (i, t, *_) in zip(got, sorted(documents), strict=True):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# the pipeline


def test_stages(spark, sf):
    """Every stage against a plain version of it, over what the stage before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        docs = spark.createDataFrame([tuple(r) for r in stage(spark, docs, sf).select(columns).collect()], docs.schema)
        kept[name] = before, [tuple(r) for r in docs.collect()]
    before, after = kept["toxicity"]
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert gone and np.mean([toxic.get(i, 1) for i in gone]) > 0.9
    assert np.mean([r[0] in gone for r in before if toxic.get(r[0]) == 1]) >= 0.8
    assert np.mean([r[0] in gone for r in before if toxic.get(r[0]) == 0]) <= 0.03
    before, after = kept["near_dedup"]
    assert {r[0] for r in after} == {i for i, (_, c) in plain_components(before, 5).items() if c == i}
    before, after = kept["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r[0] for r in after} == {i for i, (_, n, _) in plain_hits(before, items).items() if not n}
    before, after = kept["mixing"]
    assert set(after) <= set(before) and max(Counter(after).values()) <= 3
    size, taken = Counter(), Counter()
    for found, per in ((before, size), (after, taken)):
        for _, t, _, source, *_ in found:
            per[source] += len(words(t))
    order = sorted(size, key=lambda x: (x is None, x or ""))
    want = capped_targets(size, {x: i % 3 + 1.0 for i, x in enumerate(order)}, sum(size.values()), 3)
    far = [(x, taken[x], want[x]) for x in order if abs(taken[x] - want[x]) > 0.05 * want[x] + 30]  # ten documents a source
    assert not far, far
    whole, start = Tokenizer.from_file(TOKENIZER), 0
    got = sorted(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), key=lambda r: r.start)
    for r, (i, t, *_) in zip(got, sorted(after, key=lambda x: x[0]), strict=True):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_run_is_the_stages_in_turn(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 50
    ordered = sorted(got.collect(), key=lambda r: r.start)
    assert [r.start for r in ordered] == np.concatenate([[0], np.cumsum([r.n_tokens for r in ordered])[:-1]]).tolist()
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in ordered)


def test_pipeline_edges(spark, sf):
    """Null and repeated doc_ids, nulls in other columns, a clashing extra column, and no rows at all."""
    text = "alpha beta gamma delta epsilon zeta eta theta"
    found = [(None, text, None, None, None), (900001, text + " iota", "en", "s", 1), (900002, text + " idiot kappa", None, "s", 1), (900003, None, "en", None, 1), (900003, None, "en", None, 1), (900004, "one two three four five six", "en", "z", 1)]
    docs = spark.createDataFrame([(*r, "x") for r in found], SCHEMA + ", row string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert set(docs.columns) == set(out.columns)
        out.collect()
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(found)


def test_pipeline_decides_by_row(spark, sf):
    """Rows without doc_id and rows that share one stay or go each on its own."""
    stages = dict(corpus_pipeline.STAGES)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(words(r.text)) >= 10]
    clean = [" ".join(f"{w}{i}" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) for i in range(6)]
    ids = [None, None, 7, 7, None, 8]
    rows_of = lambda texts: [(i, t, "en", "s", len(t)) for i, t in zip(ids, texts, strict=True)]
    make = lambda texts: spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    texts = lambda df: sorted(r.text for r in df.collect())
    leaky = [items[0], *clean[1:3], items[1], *clean[4:]]
    assert texts(stages["decontamination"](spark, make(leaky), sf)) == sorted([*clean[1:3], *clean[4:]])
    copies = [clean[0], clean[0], clean[1], clean[1], clean[1], ""]
    assert texts(stages["near_dedup"](spark, make(copies), sf)) == sorted([clean[0], clean[1], ""])
    docs = make(clean)
    taken = stages["mixing"](spark, docs, sf)
    assert sorted(Counter(texts(taken)).values()) == [1] * 6
    stored = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {r.doc_id for r in stored.collect()} - {r.doc_id for r in stages["toxicity"](spark, stored, sf).collect()}
    toxic = next(r.text for r in stored.collect() if r.doc_id in gone and labels.get(r.doc_id))
    out = stages["toxicity"](spark, stored.unionByName(make([toxic, *clean[1:]])), sf)
    assert [r.text for r in out.collect() if r.doc_id is None] in [[a, b] for a in clean for b in clean if a != b]


def test_stages_carry_any_column_along(spark, sf, tmp_path):
    names = ("_row", "_path", "_place", "_number", "_metadata", "row_", "times_", "time_", "_copies", "_copy", "a.b")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(names))).write.parquet(str(tmp_path / "docs"))
    clash = spark.read.parquet(str(tmp_path / "docs"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, sf)
        assert out.columns == clash.columns or set(out.columns) == set(clash.columns)
        assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in stage(spark, docs, sf).collect())
        assert out.agg(F.min("_copy"), F.max("_copy")).first() == (9, 9)
