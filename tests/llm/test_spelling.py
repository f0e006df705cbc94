"""Near words against all pairs, forms and roots against plain rules."""

import random
import re
import zlib
from collections import Counter

import pytest

from serieslab.llm import spelling
from tests.llm.helpers import SCHEMA, clashing, lower, rows

WORDS = "word string, n long"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=2):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def grouped(spark, counts, **more):
    return {r.word: tuple(r)[1:] for r in spelling.spelling_groups(spark.createDataFrame(list(counts.items()), WORDS), **more).collect()}


def test_groups(spark):
    rng = random.Random(5)
    letters = "abàÿ"
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))): rng.choice([3, 3, 4, 6, 6, 12, 50, 400]) for _ in range(700)}
    assert grouped(spark, counts) == plain(counts)
    assert grouped(spark, counts, ratio=1.5) == plain(counts, 1.5)


def test_pairs_come_once(spark):
    counts = {w: 3 for w in ["aab", "aaab", "aaaab", "abab", "baab", "a", "b", "ab", "ba", "éa", "ea"]}
    pairs = [(r.a, r.b) for r in spelling.near_pairs(spark.createDataFrame(list(counts.items()), WORDS)).collect()]
    want = {(min(a, b, key=lambda w: (len(w), w)), max(a, b, key=lambda w: (len(w), w))) for a in counts for b in counts if one_edit(a, b)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_a_long_path_to_the_root(spark):
    counts = {"x" * i: 3 * 2**i for i in range(5, 40)}
    assert grouped(spark, counts) == plain(counts)


def test_common_halves(spark):
    """Five thousand words with one first half: nothing is lost, and pairs are those of the second half."""
    counts = {f"aaaa{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}q": 3 + i % 7 for i in range(5000)}
    got = {r.word: r.n_near for r in spelling.spelling_groups(spark.createDataFrame(list(counts.items()), WORDS)).collect()}
    assert all(got[w] == sum(w[:4] + x[:j] + c + x[j + 1 :] in counts for x in (w[4:],) for j in range(4) for c in "abcdefghijklmnopqrstuvwxyz" if c != x[j]) for w in list(counts)[::500])


def test_no_words_and_no_sense(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], WORDS)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_groups(spark.createDataFrame([], WORDS), ratio=1)


def test_words_of_documents(spark):
    found = [*rows(4, 60), (None, "straße Straße STRASSE naïve×naïve", None, None, None), (7, "abcde " * 300 + "Éabcde éabcde", None, None, None)]
    want = Counter()
    for i, t, *_ in found:
        for run in map(lower, re.findall("[A-Za-zÀ-ÿ]+", t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            want[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    runs = spelling.one_letter_lost(spelling.occurrences(clashing(spark, found)))
    assert {r.word: r.n for r in spelling.vocabulary(runs).collect()} == want
    assert spelling.vocabulary(spelling.occurrences(spark.createDataFrame([], SCHEMA))).count() == 0
