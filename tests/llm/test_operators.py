"""Every operator against a plain version, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from serieslab.llm import bloom, language, lm, mix, near_dedup, tokens, warc
from serieslab.llm.common import shared_dir
from serieslab.llm.components import connected
from serieslab.llm.decontaminate import decontaminate
from serieslab.llm.exact_dedup import exact_dedup
from serieslab.llm.line_dedup import line_dedup
from serieslab.llm.toxicity import toxicity
from tests.llm.helpers import SCHEMA, clashing, docs, letters, lower, prose, rows, words

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def table(spark):
    return docs(spark).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# line dedup


def plain_lines(found, least):
    keys = lambda t: [line.strip(" \t\n\x0b\x0c\r") for line in lower(t).split("\n")]
    seen = Counter(k for _, t, *_ in found for k in set(keys(t)))
    out = {}
    for i, t, *_ in found:
        kept = [line for k, line in zip(keys(t), (t or "").split("\n"), strict=True) if not k or seen[k] < least]
        out[i] = ("\n".join(kept), len(keys(t)), len(keys(t)) - len(kept))
    return out


def test_line_dedup(spark):
    found = rows()
    found = [(i, (t or "") + ("\n  Shared LINE \t" if i % 3 else "") + ("\nshared line\nrare" if i < 5 else ""), *r) if t is not None else (i, t, *r) for i, t, *r in found]
    got = line_dedup(spark.createDataFrame(found, SCHEMA).repartition(5), min_docs=10).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got} == plain_lines(found, 10)
    assert sum(r.n_dropped for r in got) > 20


def test_line_dedup_in_many_shards_and_blocks(spark, monkeypatch):
    """Filters of several shards, blocks of four documents: the lines are counted over all of them."""
    from serieslab.llm import line_dedup as module

    monkeypatch.setattr(module, "BLOCK", 2)
    found = [(i, f"all\nmod {i % 7}\nown {i}\n pair {i // 2}", "en", "s", 1) for i in range(90)]
    got = line_dedup(spark.createDataFrame(found, SCHEMA).repartition(3), min_docs=12, shard_lines=40).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got} == plain_lines(found, 12)


def test_line_dedup_keeps_first(spark):
    found = [(i, "same\nown %d\nsame" % i, "en", "s", 1) for i in range(4)]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(found, SCHEMA), min_docs=2, keep_first=True).collect()}
    assert got == {0: "same\nown 0", 1: "own 1", 2: "own 2", 3: "own 3"}


def test_line_dedup_repeated_and_null_ids(spark, empty):
    found = [(None, "x\ny", None, None, 0), (3, "x\nz", None, None, 0), (3, "x\nz", None, None, 0)]
    got = sorted((r.doc_id or -1, r.text) for r in line_dedup(spark.createDataFrame(found, SCHEMA), min_docs=3).collect())
    assert got == [(-1, "y"), (3, "z"), (3, "z")]
    assert line_dedup(empty).count() == 0


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    bits = 1 << 16
    parts = [bloom.OnceTwice(bits) for _ in range(3)]
    for i, p in enumerate(parts):
        p.see(keys[i * 1500 : i * 1500 + 2000])
    merged = next(bloom.merge_chunks(iter(p.chunks().slice(0, 1) for p in parts)))
    once, twice = (np.frombuffer(merged.column(k)[0].as_py(), np.uint8) for k in (1, 2))
    assert bloom.contains(once, bits, keys[:5000]).all()
    assert bloom.contains(twice, bits, keys[1500:2000]).all()


# decontamination


def plain_hits(found, items):
    windows = defaultdict(set)
    for k, t in items:
        w = letters(t)
        if w:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                windows[(n, tuple(w[i : i + n]))].add(str(k))
    out = {}
    for i, t, *_ in found:
        w, hit, ids = letters(t), set(), set()
        for n in {n for n, _ in windows}:
            for s in range(len(w) - n + 1):
                if (own := windows.get((n, tuple(w[s : s + n])))) is not None:
                    hit.update(range(s, s + n))
                    ids |= own
        out[i] = (len(w), len(hit), sorted(ids))
    return out


def test_decontaminate(spark):
    found, rng = rows(2), random.Random(5)
    items = [(100 + i, prose(rng, rng.choice([3, 9, 10, 11, 30]))) for i in range(12)] + [(7, None), (8, ""), (9, "!!"), (200, "ÜBER straße"), (100, prose(rng, 12))]
    found += [(1000 + i, f"{prose(rng, 5)} {t.upper() if i % 2 else t.replace(' ', ', ')} tail {t}" if t else "x", "en", "s", 0) for i, (_, t) in enumerate(items)]
    got = decontaminate(spark.createDataFrame(found, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in got} == plain_hits(found, items)


def test_decontaminate_edges(spark, table, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate(table, none).collect()} == {0}
    assert decontaminate(empty, none).count() == 0
    twice = spark.createDataFrame([(1, "a b c", "", "", 0), (1, "a b c", "", "", 0)], SCHEMA)
    assert [r.n_hit for r in decontaminate(twice, spark.createDataFrame([(5, "b c")], "item_id long, text string")).collect()] == [2, 2]


# language-model scores


def test_lm_base_and_counts(spark):
    found = rows(3)
    got = {r.doc_id: r for r in lm.lm_score(spark.createDataFrame(found, SCHEMA).repartition(3), TOKENIZER, common_words=20).collect()}
    held = {i for i, *_ in found if zlib.crc32(str(i).encode()) % 10 == 0}
    counts = Counter(w for i, t, *_ in found if i not in held for w in [*words(t), None])
    total, kinds = sum(counts.values()), len(counts)
    for i, t, *_ in found:
        own = [*words(t), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(own), sum(counts[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0


def tables():
    rng = np.random.default_rng(1)
    uni = np.zeros(lm.IDS)
    uni[:50] = rng.integers(1, 100, 50)
    uni[lm.END] = 20
    ranks = lm.Tables.ranks(uni)
    pairs = rng.integers(0, 51, (300, 2))
    key, n = np.unique(pairs[:, 0] * (lm.RANKS + 1) + pairs[:, 1], return_counts=True)
    assert ranks[lm.END] < 51
    return lm.Tables(uni, (key // (lm.RANKS + 1), key % (lm.RANKS + 1), n))


def some_weights():
    rng, w = np.random.default_rng(2), lm.start_weights()
    w["out"] = (rng.standard_normal(w["out"].shape) * 0.3).astype(np.float32)
    return w


def test_lm_is_a_distribution():
    t, w = tables(), some_weights()
    last = np.array([[3, 4, 5] + [0] * (lm.WINDOW - 3)])
    classes = np.exp(lm.class_logs(w, t, lm.attend(w, last)[-1][:, 2], np.array([5])))[0]
    within = np.exp(t.within(np.full(lm.IDS, 5), np.arange(lm.IDS)))
    assert classes.sum() == pytest.approx(1, abs=1e-5)
    assert (classes[t.class_of_id] * within).sum() == pytest.approx(1, abs=2e-3)


def test_lm_scores_do_not_depend_on_neighbours_and_are_causal():
    t, w, rng = tables(), some_weights(), np.random.default_rng(4)
    texts = [np.append(rng.integers(0, 50, n), lm.END) for n in (0, 1, 31, 32, 33, 55, 56, 57, 200)]
    sizes = np.array([len(x) for x in texts])
    whole = lm.score_ids(w, t, np.concatenate(texts), sizes)
    alone = [lm.score_ids(w, t, x, np.array([len(x)]))[0] for x in texts]
    assert whole == pytest.approx(alone, rel=1e-5)
    x = texts[5]
    assert lm.score_ids(w, t, x[:20], np.array([20]))[0] > lm.score_ids(w, t, x, np.array([len(x)]))[0]


def test_lm_scores_equal_plain_windows_without_queries_of_context(monkeypatch):
    """One window after another, attended and normalised as a whole; the context of later windows takes no exponentials as queries."""
    t, w, rng, plain, taken = tables(), some_weights(), np.random.default_rng(10), np.exp, []
    texts = [np.append(rng.integers(0, 50, n), lm.END) for n in (0, 7, 8, 31, 32, 33, 55, 56, 57, 300)]
    sizes, want = np.array([len(x) for x in texts]), []
    for x in texts:
        last = t.rank[np.append(lm.END, x[:-1])]
        total = t.within(last, x).astype(np.float64).sum()
        for _, first, scored in zip(*lm.windows(np.array([len(x)])), strict=True):
            own = np.append(last[first : first + lm.WINDOW], np.zeros(lm.WINDOW, np.int32))[: lm.WINDOW]
            logs = lm.class_logs(w, t, lm.attend(w, own[None])[-1][0], own)
            total += sum(float(logs[p - first, t.class_of_id[x[p]]]) for p in range(scored, min(len(x), first + lm.WINDOW)))
        want.append(total)

    def exp(x, *args, **kwargs):
        taken.append(np.size(x))
        return plain(x, *args, **kwargs)

    monkeypatch.setattr(np, "exp", exp)
    assert lm.score_ids(w, t, np.concatenate(texts), sizes) == pytest.approx(want, rel=1e-5)
    later = len(lm.windows(sizes)[0]) - len(texts)
    assert sum(taken) == (len(texts) * lm.WINDOW + later * (lm.WINDOW - lm.OVERLAP)) * lm.WINDOW + sizes.sum() * lm.CLASSES


def test_lm_gradient():
    t, w, rng = tables(), some_weights(), np.random.default_rng(7)
    last = rng.integers(0, 50, (3, lm.WINDOW))
    target, use = t.class_of_id[rng.integers(0, 50, (3, lm.WINDOW))], np.ones((3, lm.WINDOW), bool)

    def loss(v):
        logs = lm.class_logs(v, t, lm.attend(v, last)[-1].reshape(-1, lm.WIDTH), last.ravel())
        return logs[np.arange(len(logs)), target.ravel()].astype(np.float64).sum()

    g = lm.gradient(w, t, last, target, use)
    for name in w:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        up, down = ({k: x.copy() for k, x in w.items()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(g[name][at], rel=0.03, abs=0.02)


def test_lm_windows_score_each_token_once():
    sizes = np.array([1, 8, 31, 32, 33, 56, 57, 1000])
    text, first, scored = lm.windows(sizes)
    for i, n in enumerate(sizes):
        own = [p for f, s in zip(first[text == i], scored[text == i], strict=True) for p in range(s, min(n, f + lm.WINDOW))]
        assert own == list(range(n))


def test_lm_learns_from_every_window(monkeypatch):
    t, rng, seen = tables(), np.random.default_rng(8), []
    texts = [np.append(rng.integers(0, 50, n), lm.END) for n in (0, 1, 31, 57, 3000, *[40] * 90)]
    sizes = np.array([len(x) for x in texts])
    plain = lm.gradient

    def gradient(w, tables, last, target, use):
        seen.append(int(use.sum()))
        return plain(w, tables, last, target, use)

    monkeypatch.setattr(lm, "gradient", gradient)
    for k in range(2):
        seen.clear()
        _, steps = lm.train_part(lm.start_weights(), t, iter([(np.concatenate(texts), sizes)]), k, 0.01)
        assert sum(seen) == sizes.sum() and steps == len(seen)


def test_lm_gradient_takes_one_exponential_a_class(monkeypatch):
    """Shares of the classes come from one exponential each, and equal those of the normalised logarithms."""
    t, w, rng, plain, taken = tables(), some_weights(), np.random.default_rng(9), np.exp, []
    last, use = rng.integers(0, 50, (5, lm.WINDOW)), rng.random((5, lm.WINDOW)) < 0.7
    target = t.class_of_id[rng.integers(0, 50, (5, lm.WINDOW))]
    mixed = lm.attend(w, last)[-1][use]
    error = -plain(lm.class_logs(w, t, mixed, last[use]))
    error[np.arange(len(error)), target[use]] += 1

    def exp(x, *args, **kwargs):
        taken.append(np.size(x))
        return plain(x, *args, **kwargs)

    monkeypatch.setattr(np, "exp", exp)
    g = lm.gradient(w, t, last, target, use)
    assert sum(taken) == last.size * lm.WINDOW + use.sum() * lm.CLASSES
    assert g["out"] == pytest.approx(mixed.T @ error, abs=1e-4)


def test_lm_empty(spark, empty):
    assert lm.lm_score(empty, TOKENIZER).count() == 0


# near duplicates


def plain_components(found, k, threshold=0.8):
    sets = {}
    for i, t, *_ in found:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 100 * threshold * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_dedup(spark, k):
    found = rows(4, 100)
    got = near_dedup.near_dedup(spark.createDataFrame(found, SCHEMA).repartition(4), k=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(found, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_links_across_the_components_of_a_bucket(spark):
    """Copies of one text, edited so that few are near each other but many near the original."""
    rng = random.Random(9)
    base = prose(rng, 150).split(" ")
    found = []
    for i in range(80):
        own = list(base)
        for _ in range(rng.choice([1, 2, 4, 5, 6, 8])):
            own[rng.randrange(len(own))] = f"edit{i}"
        found.append((i + 1, " ".join(own), "en", "s", 0))
    found.append((500, " ".join(base), "en", "s", 0))
    got = near_dedup.near_dedup(spark.createDataFrame(found, SCHEMA).repartition(4), k=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(found, 4)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (900, 700))
    a = np.concatenate([a, b[:500]])
    union = np.minimum(near_dedup.minima(a), near_dedup.minima(b))
    assert (union == near_dedup.minima(np.union1d(a, b))).all()
    errors = []
    for _ in range(40):
        both, own_a, own_b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
        x, y = (near_dedup.registers(near_dedup.minima(np.concatenate([both, o]))) for o in (own_a, own_b))
        errors.append(near_dedup.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([900]), np.array([900]))[0] - 0.8)
    assert abs(np.mean(errors)) < 0.02
    assert np.abs(errors).max() < 5 * math.sqrt(0.8 * 0.2 / near_dedup.REGISTERS)


def test_near_dedup_edges(spark, empty):
    assert near_dedup.near_dedup(empty).count() == 0
    found = [(None, "a b c d e f", "", "", 0), (4, "a b c d e f", "", "", 0), (4, "a b c d e f", "", "", 0), (2, None, "", "", 0), (1, "", "", "", 0)]
    got = sorted(((r.doc_id or -1), r.component_id or -1) for r in near_dedup.near_dedup(clashing(spark, found)).collect())
    assert got == [(-1, 4), (1, 1), (2, 2), (4, 4), (4, 4)]


def test_connected(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {x for x in root if all(x not in e for e in edges if e[0] != e[1])}
    assert got == {x: r for x, r in root.items() if x not in alone}


# mixing


def test_mix(spark):
    found = rows(6, 200)
    frame = spark.createDataFrame(found, SCHEMA)
    got = mix.mix(frame.repartition(3)).collect()
    size = {i: len(words(t)) for i, t, *_ in found}
    per = Counter()
    for i, _, _, s, _ in found:
        per[s] += size[i]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    want = mix.capped_targets(per, weight, sum(per.values()), 3)
    assert sum(want.values()) == pytest.approx(sum(per.values()))
    taken = Counter()
    for r in got:
        s = r.members[0]
        assert r["size"] == size[r.doc_id] and r.source_size == per[s] and r.target == pytest.approx(want[s]) and 0 <= r.copies <= 3
        taken[s] += r["size"] * r.copies
    for s in order:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 2
    again = {r.doc_id: r.copies for r in mix.mix(frame.repartition(6)).collect()}
    assert again == {r.doc_id: r.copies for r in got}


def test_capped_targets():
    assert mix.capped_targets({"a": 1, "b": 100}, {"a": 1, "b": 1}, 101, 3) == {"a": 3.0, "b": 98.0}
    assert mix.capped_targets({"a": 0, "b": 10}, {"a": 1, "b": 1}, 10, 3) == {"a": 0.0, "b": 10.0}
    assert mix.capped_targets({}, {}, 0, 3) == {}


def test_flow_against_all_flows():
    """Overlapping sources: the flow reaches the largest total at the least cost of repetition."""
    import itertools

    patterns, quotas, most = {("a",): 2, ("a", "b"): 2, ("b",): 1}, {"a": 4, "b": 3}, 3
    best = None
    for take in itertools.product(*(range(most * n + 1) for n in patterns.values())):
        for split in range(take[1] + 1):
            a, b = take[0] + split, take[2] + take[1] - split
            if a <= 4 and b <= 3:
                cost = sum(sum(level * level * min(n, max(0, t - level * n)) for level in range(most)) for t, n in zip(take, patterns.values(), strict=True))
                if best is None or (-(a + b), cost) < best[:2]:
                    best = (-(a + b), cost, take)
    got = mix.route(patterns, quotas, most)
    cost = sum(sum(level * level * min(n, max(0, got[p] - level * n)) for level in range(most)) for p, n in patterns.items())
    assert (-sum(got.values()), cost) == best[:2]


def test_flow_of_random_networks():
    """Against a plain cheapest-path flow over unit offers."""
    rng = random.Random(12)
    for _ in range(40):
        sources = "abcde"[: rng.randint(1, 5)]
        patterns = {tuple(sorted(rng.sample(sources, rng.randint(0, len(sources))))): rng.randint(0, 6) for _ in range(rng.randint(1, 6))}
        quotas, most = {s: rng.randint(0, 9) for s in sources}, 3
        got = mix.route(patterns, quotas, most)
        # units one by one: of all patterns with an augmenting path the one with the cheapest offer
        owner, taken = {s: [] for s in sources}, Counter()

        def path(p, seen, patterns=patterns, quotas=quotas, owner=owner):
            for s in p:
                if s not in seen:
                    seen.add(s)
                    if len(owner[s]) < quotas[s]:
                        owner[s].append(p)
                        return True
                    for q in dict.fromkeys(owner[s]):
                        if path(q, seen):
                            owner[s].remove(q)
                            owner[s].append(p)
                            return True
            return False

        for level in range(most):
            for p, n in patterns.items():
                for _ in range(n):
                    if not path(p, set()):
                        break
                    taken[p, level] += 1
        per = Counter()
        for (_, level), n in taken.items():
            per[level] += n
        own = Counter()
        for p, t in got.items():
            for level in range(most):
                own[level] += min(patterns[p], max(0, t - level * patterns[p]))
        assert +own == +per


def test_mix_of_very_many_patterns(spark):
    """200,000 patterns of two sources each."""
    i = F.col("id")
    groups = F.array(F.concat(F.lit("a"), (i % 500).cast("string")), F.concat(F.lit("b"), F.floor(i / 500).cast("string")))
    docs = spark.range(200_000).select(i.alias("doc_id"), F.repeat(F.lit("w "), (i % 7 + 1).cast("int")).alias("text"), groups.alias("groups"))
    got = mix.mix(docs, members="groups").agg(F.count(F.lit(1)), F.sum(F.col("size") * F.col("copies")), F.sum("size"), F.max("copies")).first()
    assert got[0] == 200_000 and got[3] <= 3 and got[1] == pytest.approx(got[2], rel=0.02)


def test_mix_overlapping_and_edges(spark, empty):
    frame = spark.createDataFrame([(i, "w " * (i % 9 + 1), [["a"], ["a", "b"], ["b"], None][i % 4]) for i in range(200)], "doc_id long, text string, groups array<string>")
    got = mix.mix(frame, members="groups").collect()
    assert len(got) == 200 and all(0 <= r.copies <= 3 for r in got)
    assert mix.mix(empty).count() == 0
    assert [r.copies for r in mix.mix(clashing(spark, [(1, None, "", "s", 0), (1, "", "", "s", 0)])).collect()] == [0, 0]


# WARC


def test_warc(spark, tmp_path):
    rng = random.Random(2)
    same = prose(rng, 60)
    pages = [(i, f"http://www.Site{i % 5}.org:80/p/{i % 17}?q={i}#x", [same, prose(rng, 50), "short", None, ""][i % 5]) for i in range(300)] + [(900, None, same), (901, "no scheme", "é" * 60)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    path = shared_dir(spark, "warc-test")
    warc.archive(frame, path)
    records = warc.read_warc(warc.keys_of(frame), f"{path}/index", f"{path}/warc")
    first = {}
    for i, _, html in sorted(pages, key=lambda p: p[0]):
        first.setdefault(html or "", i)
    got = {r.page_id: r for r in warc.resolved(records).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        body, r = (html or "").encode(), got[i]
        again = len(body) >= 100 and first[html] != i
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[html] if again else None)
    payloads = {r.page_id: bytes(r.payload) for r in records.filter("record_type = 'response'").collect()}
    assert all(payloads[i] == (html or "").encode() for i, _, html in pages if i in payloads)
    for url in (pages[7][1], "http://nowhere.org/"):
        want = sorted(i for i, u, _ in pages if warc.url_key(u) == warc.url_key(url))
        assert sorted(warc.page_of(f["WARC-Record-ID"]) for f, _ in warc.lookup(f"{path}/index", f"{path}/warc", url)) == want
    few = spark.createDataFrame([(pages[7][1],), ("http://nowhere.org/",)], "url string")
    assert [r.page_id for r in warc.read_warc(warc.keys_of(few), f"{path}/index", f"{path}/warc").collect()] == [7]


def test_warc_tells_rows_apart(spark, monkeypatch):
    """Repeated and null page_ids, odd urls, one url with most captures: no row is lost, doubled or given another's payload."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    a, b, c = (x * 120 for x in "abc")
    hot = "http://hot.org/\tx y\nz"
    pages = [(1, "u", a), (5, "v", a), (5, "v", a), (5, hot, b), (0, None, b), (None, hot, a), (None, "w", c), (None, "w", c), (7, "w", "short"), (7, "w", "short")]
    pages += [(100 + i, hot, f"{i}" * 150) for i in range(60)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    path = shared_dir(spark, "warc-rows")
    warc.archive(frame, path)
    records = warc.read_warc(warc.keys_of(frame), f"{path}/index", f"{path}/warc")
    least = {x: min((i for i, _, h in pages if h == x and i is not None), default=None) for _, _, x in pages}
    key = lambda i, html: (str(i), len(html), hashlib.sha256(html.encode()).hexdigest())
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in warc.resolved(records).collect()) == sorted(key(i, h) for i, _, h in pages)
    out = [(r.payload_digest, r.record_type, r.page_id, r.refers_to) for r in warc.resolved(records).collect()]
    for html in (a, b, c):
        own = [x[1:] for x in out if x[0] == key(0, html)[2]]
        assert [x for x in own if x[0] == "response"] == [("response", least[html], None)]
        assert all(x[2] == least[html] for x in own if x[0] == "revisit")
    assert [x[1] for x in out if x[0] == key(0, "short")[2]] == ["response"] * 2
    whole = records.filter("record_type = 'response'").select("payload").collect()
    assert {bytes(r.payload).decode() for r in whole} == {h for _, _, h in pages}
    assert len(warc.lookup(f"{path}/index", f"{path}/warc", hot)) == 62


def test_warc_keys_and_empty(spark):
    assert warc.url_key("http://user@M.a.org:80/B?x#y") == "org,a,m)/b?x"
    assert warc.url_key(None) == ")/" and warc.url_key("https://a.b") == "b,a)/"
    path = shared_dir(spark, "warc-empty")
    directory = warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert directory.count() == 0


# language identification


def test_crf_against_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    scores, steps = rng.standard_normal((1, 5, 3)).astype(np.float32), rng.standard_normal((3, 3)).astype(np.float32)
    total = np.zeros((5, 3))
    pairs = np.zeros((3, 3))
    z = 0
    for path in itertools.product(range(3), repeat=4):
        p = math.exp(sum(scores[0, t, y] for t, y in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:], strict=False)))
        z += p
        for t, y in enumerate(path):
            total[t, y] += p
        for a, b in zip(path, path[1:], strict=False):
            pairs[a, b] += p
    keep = np.array([[True] * 4 + [False]])
    found, moved = language.forward_backward(scores, steps, keep)
    assert found[0, :4] == pytest.approx(total[:4] / z, abs=1e-4)
    assert moved == pytest.approx(pairs / z, abs=1e-4)


def test_posteriors_of_long_texts_are_exact():
    """Texts of many blocks against one pass over each whole text, with transitions that carry far."""
    rng = np.random.default_rng(3)
    emitted, steps = (rng.standard_normal((30, 3)) * 0.05).astype(np.float32), (np.eye(3) * 6).astype(np.float32)
    sizes = [0, 1, 191, 192, 193, 384, 385, 2000, 5]
    offsets, codes = np.cumsum([0, *sizes]), rng.integers(0, 30, sum(sizes))
    codes[offsets[7] : offsets[7] + 3] = 0
    emitted[0] = [9, 0, 0]  # what the first words say reaches the end
    got = language.posteriors(codes, offsets, emitted, steps, together=4)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b > a:
            whole = language.forward_backward(emitted[codes[a:b]][None], steps, np.ones((1, b - a), bool))[0][0]
            assert got[a:b] == pytest.approx(whole, abs=1e-4)


def test_language_tells_rows_apart(spark):
    """Rows without doc_id, or with one that repeats, are learnt from and labelled each on its own."""
    rng = random.Random(2)
    found = [([None, 5, 9][i % 2], speak(rng, ["en", "fr"][i // 2 % 2], 30), ["en", "fr"][i // 2 % 2], "s", 0) for i in range(120)]
    got = language.identify(spark.createDataFrame(found, SCHEMA).repartition(2), most_per_language=40).collect()
    assert len(got) == 120 and Counter(r.lang_pred for r in got) == {"en": 60, "fr": 60}


def speak(rng, lang, n):
    parts = {"en": ["th", "ing", "er", "ou"], "fr": ["eau", "é", "ion", "que"], "de": ["sch", "ung", "ei", "z"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(n))


def test_language(spark, empty):
    rng = random.Random(8)
    found = [(i, speak(rng, ["en", "fr", "de"][i % 3], rng.randint(4, 60)), ["en", "fr", "de"][i % 3], "s", 0) for i in range(240)]
    odd = [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "12 34 !!", "fr", "s", 0), (1003, speak(rng, "fr", 20000), None, "s", 0), (1004, speak(rng, "de", 40) + " " + speak(rng, "en", 20), None, "s", 0)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(found + odd, SCHEMA).repartition(3)).collect()}
    right = [got[i].lang_pred == lang for i, _, lang, *_ in found]
    assert np.mean(right) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "fr", "de"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == 0
    assert got[1004].shares[0] > 0.2  # de first by code point
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert language.identify(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "hello", None, "s", 0)], SCHEMA)
    assert [r.lang_pred for r in language.identify(unlabelled).collect()] == ["und"]


# tokens


def test_word_encoder_equals_whole_texts():
    from tokenizers import Tokenizer

    texts = [t or "" for _, t, *_ in rows(7)] + ["", "  ", "́a b", "a b c", "ΑΣ ΑΣ.", "<|endoftext|> x<|startoftext|>y", "<|ENDOFTEXT|>.", "it's 'tis don't 123 ４５ x'. 'll", "é ẹ́ İ ß Ǆ", "a\x0bb\x0cc\rd", "wow!!! ((((((((((((((end)))))))))))))", "日本語 テキスト 🙂🙂", "…. x…. 5€, ½."]
    coder, whole = tokens.WordEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for _ in range(2):  # the second time from what was learnt
        ids, counts = coder.encode(pa.array(texts), 2)
        got = np.split(ids, np.cumsum(counts)[:-1])
        assert [g.tolist() for g in got] == [e.ids + [2] for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_word_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    coder, rng = tokens.WordEncoder(TOKENIZER), random.Random(1)
    fresh = tokens.WordEncoder(TOKENIZER)
    for i in range(20):
        texts = pa.array([prose(rng, 30) + f" w{i} v{i * 7}."])
        assert coder.encode(texts, None)[0].tolist() == tokens.WordEncoder(TOKENIZER).encode(texts, None)[0].tolist()
    assert fresh.known == {"": 0}


def test_token_files(spark, table, empty):
    from tokenizers import Tokenizer

    path = shared_dir(spark, "token-test")
    tokens.write_tokens(table, TOKENIZER, path, row_group_bytes=1 << 16)
    got = sorted(tokens.with_crc(tokens.read_tokens(spark, path)).collect(), key=lambda r: r.doc_id)
    whole, start = Tokenizer.from_file(TOKENIZER), 0
    for r, (i, t, *_) in zip(got, sorted(rows()), strict=True):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.with_crc(tokens.token_output(empty, TOKENIZER)).count() == 0


def test_token_file_format(spark, table):
    import glob

    import pyarrow.parquet as pq

    path = shared_dir(spark, "token-format")
    tokens.write_tokens(table, TOKENIZER, path)
    group = pq.ParquetFile(max(glob.glob(f"{path.removeprefix('file://')}/*.parquet"))).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index


def test_repeated_ids_keep_their_place(spark):
    frame = clashing(spark, [(5, "b", "", "", 0), (5, "a", "", "", 0), (5, "a", "", "", 0), (None, "c", "", "", 0)])
    got = sorted(((r.doc_id or -1), r.start, r.n_tokens) for r in tokens.token_output(frame, TOKENIZER).collect())
    assert got == [(-1, 0, 2), (5, 2, 2), (5, 4, 2), (5, 6, 2)]


# exact duplicates


def test_exact_dedup(spark, table, empty):
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[lower(t)].append(i)
    got = {r.doc_id: r for r in exact_dedup(table).collect()}
    assert len(got) == len(rows())
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_digits(spark):
    """Texts that part just before, at and after the ends of digits."""
    found = [(i, "x" * n + tail, "", "", 0) for i, (n, tail) in enumerate((n, t) for n in (63, 64, 65, 319, 320, 321, 1343, 1344, 5440, 40000) for t in ("", "a", "b", "a"))]
    groups = Counter(t for _, t, *_ in found)
    assert {r.doc_id: r.group_size for r in exact_dedup(clashing(spark, found)).collect()} == {i: groups[t] for i, t, *_ in found}


def test_exact_dedup_repeated_ids(spark):
    got = exact_dedup(spark.createDataFrame([(1, "a", "", "", 0), (1, "a", "", "", 0), (None, "A", "", "", 0)], SCHEMA)).collect()
    assert [r.group_size for r in got] == [3, 3, 3] and sum(r.kept for r in got) == 1 and {r.keep_id for r in got} == {1}


# toxicity


def insulted(rng, toxic):
    text = prose(rng, rng.randint(20, 80)).split(" ")
    if toxic:
        for _ in range(3):
            text[rng.randrange(len(text))] = rng.choice(["idiot", "scum.", "Moron", "worthless"])
    return " ".join(text)


def test_toxicity(spark, empty):
    rng = random.Random(4)
    found = [(i, insulted(rng, i % 6 == 0), "en", "s", 0) for i in range(600)] + [(2000, None, "", "", 0), (2001, "", "", "", 0)]
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(500)] + [(3, None), (None, 1), (6, 1), (9999, 1)], "doc_id long, label int")
    got = {r.doc_id: r for r in toxicity(spark.createDataFrame(found, SCHEMA).repartition(3), labels).collect()}
    assert [got[i].predicted for i in range(600)] == [int(i % 6 == 0) for i in range(600)]
    assert got[2000].predicted == got[2001].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    held = {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(set(r.evidence).isdisjoint(held) for r in got.values()) and all(got[i].held_out == (i in held) for i in range(600))
    assert all(got[i].evidence for i in range(0, 600, 6))
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.predicted for r in toxicity(spark.createDataFrame(found[:20], SCHEMA), none).collect()} == {0}
    assert toxicity(empty, labels).count() == 0


def test_block_max_index_is_exact(monkeypatch):
    from serieslab.llm import toxicity as module

    monkeypatch.setattr(module, "DENSE", 6)
    rng = random.Random(6)

    def vector():
        raw = {rng.choice([rng.randrange(8), rng.randrange(60)]): rng.random() for _ in range(rng.randint(1, 8))}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {f: x / norm for f, x in sorted(raw.items())}

    def joined(found):
        return np.cumsum([0, *map(len, found)]), np.array([f for v in found for f in v], np.int64), np.array([w for v in found for w in v.values()])

    vectors, asked = [vector() for _ in range(1700)], [vector() for _ in range(60)] + [{}]
    index = module.Index(*joined(vectors), 60)
    for without in (None, np.arange(len(asked))):
        for k, (q, (got, place)) in enumerate(zip(asked, index.nearest(*joined(asked), None if without is None else index.place[without]), strict=True)):
            plain = [sum(w * v.get(f, 0) for f, w in q.items()) * (without is None or i != k) for i, v in enumerate(vectors)]
            assert got == pytest.approx([s for s in sorted(plain, reverse=True)[: module.NEIGHBOURS] if s > 0], abs=1e-5)
            assert [plain[index.order[p]] for p in place] == pytest.approx(got, abs=1e-5)


def test_repeated_doc_ids_are_one_example(spark):
    """Of texts that share a doc_id the smallest is learnt from; each row is scored."""
    rng = random.Random(8)
    found = [(i, insulted(rng, i % 6 == 0), "en", "s", 0) for i in range(200)] + [(6, "zzz", "en", "s", 0), (None, "scum idiot moron", "en", "s", 0)]
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(200)], "doc_id long, label int")
    runs = [sorted((r.doc_id or -1, r.score) for r in toxicity(spark.createDataFrame(found, SCHEMA).repartition(n), labels).collect()) for n in (1, 5)]
    assert [i for i, _ in runs[0]] == [i for i, _ in runs[1]] and len(runs[0]) == 202
    assert [s for _, s in runs[0]] == pytest.approx([s for _, s in runs[1]])


def test_words_of_batches():
    from serieslab.llm.words import LETTERS_DIGITS, NOT_BLANK, Words, count_words, lowered, together

    texts = [t for _, t, *_ in rows(9)] + ["abc", "def", "", "x"]
    assert count_words(lowered(pa.array(texts))).tolist() == [len(words(t)) for t in texts]
    for kind, plain in ((NOT_BLANK, words), (LETTERS_DIGITS, letters)):
        for first, part in together(lowered(pa.array(texts)), 2000):
            w = Words(part, kind)
            for i in range(len(part)):
                own = [w.text(j, j + 1) for j in range(w.first[i], w.first[i + 1])]
                assert own == plain(texts[first + i])
            hashed = defaultdict(set)
            for j, h in enumerate(w.hashes().tolist()):
                hashed[h].add(w.text(j, j + 1))
            assert all(len(x) == 1 for x in hashed.values()) and len(hashed) == len(set().union(*hashed.values())) if hashed else True


def test_calibration_of_separable_votes():
    from serieslab.llm.toxicity import calibrate, logit

    slope, shift = calibrate(np.array([0.001] * 500 + [0.999] * 40), np.array([0.0] * 500 + [1.0] * 40))
    assert math.isfinite(slope) and slope > 0.5
    z = slope * logit(np.array([0.001, 0.999])) + shift
    assert z[0] < -3 and z[1] > 3


# Names of other columns, and splits of files

TAKEN = ("_row", "_path", "_place", "_number", "_metadata", "row", "row_", "path_", "number_", "place_", "times_", "time_", "_copies", "_copy", "a.b")


def with_taken_names(spark, found, path):
    """Files of documents whose other columns are called as the helpers of operators might call theirs."""
    df = docs_of(spark, found)
    df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(TAKEN))).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def docs_of(spark, found):
    return spark.createDataFrame(found, SCHEMA)


def test_names_that_clash(spark, tmp_path):
    found = rows(9, 40)
    clash, plain = with_taken_names(spark, found, str(tmp_path / "docs")), docs_of(spark, found)
    same = lambda f, *drop: sorted(map(str, f(clash).drop(*drop).collect())) == sorted(map(str, f(plain).drop(*drop).collect()))
    assert same(line_dedup)
    assert same(exact_dedup, "row")
    assert same(lambda df: mix.mix(df), "row")
    assert language.identify(clash).count() == len(found)  # which rows it learns from depends on where they lie
    pages = clash.select("*", F.col("doc_id").alias("page_id"), F.lit("http://a.org/").alias("url"), F.col("text").alias("html"))
    pages.write.parquet(str(tmp_path / "pages"))
    path = shared_dir(spark, "warc-clash")
    warc.archive(spark.read.parquet(str(tmp_path / "pages")), path)
    assert warc.resolved(warc.read_warc(warc.keys_of(pages), f"{path}/index", f"{path}/warc")).count() == len(found)


def test_mix_is_the_same_however_files_are_split(spark, sf, tmp_path):
    path = str(tmp_path / "docs")
    spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet").repartition(1).write.option("parquet.block.size", 200_000).parquet(path)
    seen = []
    try:
        for most in ("1g", "400k", "60k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            seen.append(sorted((r.doc_id, r.copies) for r in mix.mix(spark.read.parquet(path)).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] == seen[2]


def test_counts_look_a_batch_up_once(monkeypatch):
    """The distinct pieces of a batch are looked up in the vocabulary together, however many texts it has; an index counts as before."""
    from serieslab.llm import toxicity as module

    texts = pa.array([" ".join(f"word{(i * 7 + j) % 50} same" for j in range(400)) for i in range(600)])
    assert 1 << 20 < sum(pa.compute.binary_length(texts).to_pylist()) < module.BATCH_BYTES
    calls, own = [], module.pieces
    monkeypatch.setattr(module, "pieces", lambda part: (calls.append(1), own(part))[1])
    found = module.Vocabulary(pa.array(["same", "word"])).counts(texts)
    assert len(calls) == 1 and found[0].tolist() == list(range(0, 1201, 2)) and set(found[2].tolist()) == {400}


def test_stages_begin_with_the_driver_given_back(spark):
    """Numbering the rows of a stage makes the JVM collect, so that its heap does not stay as an earlier stage left it."""
    import corpus_pipeline

    beans = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = beans()
    corpus_pipeline._numbered(docs(spark))
    assert beans() > before


def test_examples_that_are_alike_share_blocks():
    """Blocks hold examples of one kind even if the heaviest feature of each is its own, so that bounds can leave out blocks of other kinds."""
    from serieslab.llm import toxicity as module

    rng, kinds, each = np.random.default_rng(3), 4, 2 * module.BLOCK
    kind = rng.permutation(np.repeat(np.arange(kinds), each))
    found = [np.concatenate([np.sort(rng.choice(40, 12, replace=False)) + 40 * k, [40 * kinds + i]]) for i, k in enumerate(kind)]
    weights = [np.concatenate([np.full(12, 0.26), [np.sqrt(1 - 12 * 0.26**2)]]).astype(np.float32) for _ in found]
    index = module.Index(np.cumsum([0, *map(len, found)]), np.concatenate(found).astype(np.int32), np.concatenate(weights), 40 * kinds + len(found))
    assert sorted(index.order) == list(range(len(found))) and (index.place[index.order] == np.arange(len(found))).all()
    shares = [np.bincount(kind[index.order[i : i + module.BLOCK]]).max() / module.BLOCK for i in range(0, len(found), module.BLOCK)]
    assert np.mean(shares) > 0.8  # of the commonest kind in a block; 0.25 to 0.35 if kinds are mixed


def test_batches_are_joined():
    from serieslab.llm.common import joined

    parts = [pa.record_batch([pa.array([f"{i} {'x' * 90}" for i in range(a, b)])], ["text"]) for a, b in ((0, 10), (10, 10), (10, 25), (25, 26), (26, 90))]
    got = list(joined(iter(parts), 3000))
    assert [t for b in got for t in b.column(0).to_pylist()] == [t for b in parts for t in b.column(0).to_pylist()]
    assert [b.num_rows for b in got] == [26, 64] and list(joined(iter([]), 9)) == []
