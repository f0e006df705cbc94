"""Toxicity scores from the nearest labelled examples, by exact TF-IDF cosine over a block-max index."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslab.llm.common import BATCH_BYTES, arrow_map, crc_mod, give_back, joined, keep, row_id, splitmix
from serieslab.llm.tokens import ragged
from serieslab.llm.words import lowered, pieces, together

#: Examples of one block of the index, blocks that a search scores first, and neighbours that vote.
BLOCK, FIRST, NEIGHBOURS = 64, 16, 25
#: The power of the cosine that a neighbour's vote weighs, and the least factor of a feature beside its idf.
SHARPNESS, LEAST_GAIN = 4, 0.1
#: Features with a row of the matrix of weights, characters of a prefix, and numbers of a sketch that orders examples.
DENSE, PREFIX, SKETCH = 1024, 4, 64
#: Tasks that hold the examples, pieces counted at once, and features whose counts make one row.
TASKS, TOGETHER, CHUNK = 24, 500_000, 1 << 14
#: Bytes of texts whose distinct pieces are looked up at once: a look-up hashes the whole vocabulary, however few ask.
LOOKED_UP = 4 * BATCH_BYTES


def features(distinct: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (runs of letters) in blank-separated pieces and prefixes of longer ones, with a final hyphen; the piece of each."""
    lists = pc.split_pattern_regex(distinct, r"\P{L}+")
    words, piece = lists.flatten(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    size = pc.utf8_length(words).to_numpy()
    full, long = pa.array(size > 0), pa.array(size > PREFIX)
    prefixes = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words.filter(long), 0, PREFIX), "-", "")
    return pa.concat_arrays([words.filter(full), prefixes]), np.concatenate([piece[size > 0], piece[size > PREFIX]])


class Vocabulary:
    """Numbers of all features of the examples; counts them in other texts."""

    def __init__(self, names: pa.Array) -> None:
        self.names = names

    def __len__(self) -> int:
        return len(self.names)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's features begin, their numbers in rising order, and how often each occurs."""
        begins, found, often = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for _, part in together(lowered(texts), LOOKED_UP):  # each part looks its distinct pieces up once
            own, feature, count = self._counts(part)
            begins.append(own[1:] + begins[-1][-1])
            found.append(feature)
            often.append(count)
        return np.concatenate(begins), np.concatenate(found), np.concatenate(often)

    def _counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, distinct, offsets = pieces(texts)
        found, piece = features(distinct)
        number = pc.fill_null(pc.index_in(found, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(piece[number >= 0], kind="stable")
        flat, sizes = number[number >= 0][order], np.bincount(piece[number >= 0], minlength=len(distinct))
        begins = np.cumsum(sizes) - sizes
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(codes), TOGETHER):  # a very long text comes in parts
            part = codes[at : at + TOGETHER]
            doc = np.searchsorted(offsets, np.arange(at, at + len(part)), "right") - 1
            own = np.repeat(doc, sizes[part]) * len(self) + ragged(flat, begins[part], sizes[part])
            key, count = np.unique(own, return_counts=True)
            keys.append(key)
            counts.append(count)
        keys, counts, n = np.concatenate(keys), np.concatenate(counts), len(self) or 1
        order = np.argsort(keys, kind="stable")  # quick, as each part is in order and only texts cut in two are in several
        keys = keys[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
        counts = np.add.reduceat(counts[order], new) if len(keys) else counts
        keys = keys[new]
        return np.searchsorted(keys, np.arange(len(texts) + 1) * n), (keys % n).astype(np.int32), counts.astype(np.int32)


def sketches(owner: np.ndarray, feature: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """A row of SKETCH numbers for each of n vectors: its features, dealt to places with signs by a hash of their number."""
    hashed = splitmix(np.arange(feature.max(initial=0) + 1, dtype=np.uint64))
    cell = (hashed % np.uint64(SKETCH)).astype(np.int32)[feature] + owner * np.int32(SKETCH)
    return np.bincount(cell, np.where(hashed >> np.uint64(63), weight.dtype.type(1), weight.dtype.type(-1))[feature] * weight, n * SKETCH).reshape(n, SKETCH)


def alike(rows: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows in which alike ones stand near: halved along the direction in which they differ most, down to blocks of ``size``."""
    done, todo = [np.zeros(0, np.int64)], [np.arange(len(rows))]
    while todo:
        own = todo.pop()
        if len(own) <= size:
            done.append(own)
            continue
        apart = rows[own] - rows[own].mean(axis=0)
        main = np.linalg.eigh(apart.T @ apart)[1][:, -1]
        own = own[np.argsort(apart @ main, kind="stable")]
        half = -(-len(own) // (2 * size)) * size
        todo += [own[half:], own[:half]]
    return np.concatenate(done)


class Index:
    """Unit vectors of the examples, laid out for exact search.

    The DENSE commonest features, whose postings hold a large part of all examples, are rows of a matrix.
    All others have postings in example order, cut into blocks of BLOCK examples with their largest weight.
    """

    def __init__(self, begins: np.ndarray, feature: np.ndarray, weight: np.ndarray, n_features: int) -> None:
        """begins, feature, weight: the vectors, one after another."""
        n = len(begins) - 1
        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(begins))
        self.order = alike(sketches(owner, feature, weight, n), BLOCK)  # alike examples share blocks
        self.place = np.empty(n, np.int32)
        self.place[self.order] = np.arange(n)
        self.blocks, example = -(-n // BLOCK), self.place[owner]
        df = np.bincount(feature, minlength=n_features)
        common = np.argsort(-df, kind="stable")[:DENSE]
        self.row = np.full(n_features, -1, np.int32)
        self.row[common] = np.arange(len(common))
        dense = self.row[feature] >= 0
        self.cells = self.row[feature[dense]], example[dense], weight[dense].astype(np.float32)
        self._matrix = self._example = None
        del owner
        give_back()
        feature, example, weight = feature[~dense], example[~dense], weight[~dense]
        by = np.argsort(feature.astype(np.int64) * (n + 1) + example, kind="stable")
        self.weight = weight[by].astype(np.float32)
        entry = feature[by].astype(np.int64) * self.blocks + example[by] // BLOCK
        self.inner = (example[by] % BLOCK).astype(np.uint8)
        del by, feature, example, weight
        self.post = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else np.zeros(0, np.int64)
        self.block = (entry[self.post] % max(1, self.blocks)).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, self.post) if len(entry) else self.weight
        self.first = np.searchsorted(entry[self.post], np.arange(n_features + 1) * self.blocks).astype(np.int32)
        self.post = np.append(self.post, len(entry)).astype(np.int32)

    @property
    def matrix(self) -> np.ndarray:
        """Weights of the common features, put in their places where they are first needed: the driver sends only the cells."""
        if self._matrix is None:
            self._matrix = np.zeros((int((self.row >= 0).sum()), self.blocks * BLOCK), np.float32)
            self._matrix[self.cells[0], self.cells[1]] = self.cells[2]
        return self._matrix

    @property
    def example(self) -> np.ndarray:
        """Place of the example of each posting; like the matrix, made where it is first needed."""
        if self._example is None:
            self._example = np.repeat(self.block * np.int32(BLOCK), np.diff(self.post)) + self.inner
        return self._example

    def nearest(self, begins: np.ndarray, feature: np.ndarray, weight: np.ndarray, without: np.ndarray | None = None, together: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query vector the cosine and place of its NEIGHBOURS nearest examples with a cosine above 0, exactly.

        ``without`` has the place of an example that each query must not find. One product gives the
        share of the common features in all cosines of ``together`` queries.
        """
        n = len(begins) - 1
        for at in range(0, n, together):
            own = slice(begins[at], begins[min(n, at + together)])
            row = self.row[feature[own]]
            owner = np.repeat(np.arange(min(n, at + together) - at), np.diff(begins[at : at + together + 1]))
            query = np.zeros((min(n, at + together) - at, len(self.matrix)), np.float32)
            query[owner[row >= 0], row[row >= 0]] = weight[own][row >= 0]
            for i, known in enumerate(query @ self.matrix, at):
                own = slice(begins[i], begins[i + 1])
                rare = self.row[feature[own]] < 0
                yield self._best(known, feature[own][rare], weight[own][rare], -1 if without is None else without[i])

    def _best(self, known: np.ndarray, feature: np.ndarray, weight: np.ndarray, without: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of one query, given the share of the common features in its cosines.

        The largest weights of a block bound what rare features add in it. Blocks are scored by falling
        bound, FIRST of them and then all that could still hold a nearer example.
        """
        if without >= 0:
            known[without] = 0
        begins = self.first.take(feature)
        sizes = self.first.take(feature + 1) - begins
        entries, w = _spans(begins, sizes), np.repeat(weight, sizes)
        block, by_block = self.block.take(entries), known.reshape(self.blocks, BLOCK)
        highest = by_block.max(axis=1, initial=0)
        bound = highest + np.bincount(block, w * self.most.take(entries), self.blocks)
        score, place, at, size = np.zeros(0), np.zeros(0, np.int64), 0, FIRST
        least = np.partition(highest, -NEIGHBOURS)[-NEIGHBOURS] if self.blocks > NEIGHBOURS else 0.0  # so many examples have it at least
        order = np.flatnonzero((bound > 0) & (bound >= least - 1e-6))
        order = order[np.argsort(-bound[order], kind="stable")]
        while at < len(order):
            now, chosen = order[at : at + size], np.zeros(self.blocks, bool)
            chosen[now] = True
            inside = np.flatnonzero(chosen.take(block))
            sums = (by_block + self._rare(entries.take(inside), w.take(inside)))[now].ravel()
            if len(score) == NEIGHBOURS:
                hit = np.flatnonzero(sums >= score[-1])  # nothing below the last of so many is among them
            else:
                hit = np.flatnonzero(sums)
                if len(hit) > NEIGHBOURS + 1:  # one may be the example itself
                    values = sums[hit]
                    hit = hit[values >= np.partition(values, -NEIGHBOURS - 1)[-NEIGHBOURS - 1]]
            found = now[hit // BLOCK] * BLOCK + hit % BLOCK
            hit, found = hit[found != without], found[found != without]
            score, place = np.concatenate([score, sums[hit]]), np.concatenate([place, found])
            best = np.lexsort((self.order.take(place), -score))[:NEIGHBOURS]
            score, place, at = score[best], place[best], at + size
            if len(score) == NEIGHBOURS:
                order = order[: np.searchsorted(-bound[order], 1e-6 - score[-1], "right")]
            size = max(1, len(order) - at)
        return score, place

    def _rare(self, entries: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What rare features with weights ``w`` add in the blocks of ``entries``, by block and example.

        The postings of one feature in successive blocks lie side by side and are read as one run.
        """
        if not len(entries):
            return np.zeros((self.blocks, BLOCK))
        start = np.flatnonzero(np.concatenate([[True], (entries[1:] - entries[:-1] != 1) | (w[1:] != w[:-1])]))
        begins, ends = self.post.take(entries[start]), self.post.take(entries[np.append(start[1:], len(entries)) - 1] + 1)
        posts, value = _spans(begins, ends - begins), np.repeat(w[start], ends - begins)
        value *= self.weight.take(posts)
        return np.bincount(self.example.take(posts), value, self.blocks * BLOCK).reshape(self.blocks, BLOCK)


def _spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of several spans, one after another."""
    out = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    out += np.arange(len(out))
    return out


class Model:
    """Features with their weights, and the index of the examples with their labels."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray, begins: np.ndarray, feature: np.ndarray, counts: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> None:
        self.vocabulary, self.weights = vocabulary, weights.astype(np.float32)
        self.index = Index(begins, feature, self.vectors(begins, feature, counts), len(vocabulary))
        self.labels, self.ids = labels[self.index.order], ids[self.index.order]
        self.prior = (labels.sum() + 0.5) / (len(labels) + 2)
        empty = labels[np.diff(begins) == 0]
        self.rest = (empty.sum() + self.prior) / (len(empty) + 1)  # of texts without any feature

    def vectors(self, begins: np.ndarray, feature: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """TF-IDF weights of texts, each of length 1."""
        w = (1 + np.log(counts, dtype=np.float32)) * self.weights[feature]
        owner = np.repeat(np.arange(len(begins) - 1, dtype=np.int32), np.diff(begins))
        return w / np.sqrt(np.bincount(owner, w * w, len(begins) - 1)).astype(np.float32)[owner]

    def votes(self, texts: pa.Array, without: list[int] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Weighted share of label 1 among each text's neighbours (nan without features), and their doc_ids, nearest first.

        A neighbour's vote weighs a power of its cosine; one for the prior weighs 0.05. ``without`` has
        the number of the example that each text is.
        """
        begins, feature, counts = self.vocabulary.counts(texts)
        weight = self.vectors(begins, feature, counts)
        votes, near = np.full(len(texts), np.nan), []
        for i, (score, place) in enumerate(self.index.nearest(begins, feature, weight, None if without is None else self.index.place[without])):
            near.append(self.ids[place])
            if begins[i + 1] > begins[i]:
                w = score**SHARPNESS
                votes[i] = (w[self.labels[place] == 1].sum() + 0.05 * self.prior) / (w.sum() + 0.05)
        return votes, near


def calibrate(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic scaling of the leave-one-out votes, held near the identity; Newton steps that must not lose."""
    x, theta = logit(votes), np.array([1.0, 0.0])

    def loss(t: np.ndarray) -> float:
        z = t[0] * x + t[1]
        return float((np.logaddexp(0, z) - labels * z).sum() + ((t - [1.0, 0.0]) ** 2).sum())

    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(theta[0] * x + theta[1], -500, 500)))
        grad = np.array([((p - labels) * x).sum(), (p - labels).sum()]) + 2.0 * (theta - [1.0, 0.0])
        s = p * (1 - p)
        step = np.linalg.solve(np.array([[(s * x * x).sum() + 2.0, (s * x).sum()], [(s * x).sum(), s.sum() + 2.0]]), grad)
        while np.abs(step).max() > 1e-9 and loss(theta - step) > loss(theta):
            step = step / 2
        theta = theta - step
    return max(0.1, float(theta[0])), float(theta[1])


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def gains(df: np.ndarray, toxic: np.ndarray, n: int, n1: int) -> np.ndarray:
    """Log-likelihood ratio of each feature and the label: df examples have it, ``toxic`` of these have label 1."""
    term = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0.0)
    n0 = n - n1
    return 2 * np.maximum(0, term(toxic, df * n1 / n) + term(df - toxic, df * n0 / n) + term(n1 - toxic, n1 * (n - df) / n) + term(n0 - df + toxic, n0 * (n - df) / n))


def document_counts(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many of all documents each feature occurs, and how many documents there are.

    A task sends its counts packed, in rows of CHUNK features, and these are summed by their number.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = "chunk int, counts binary, docs long"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = sent.value, 0
        found = np.zeros(-(-(len(own) + 1) // CHUNK) * CHUNK, np.int64)
        for batch in joined(batches, LOOKED_UP):
            found += np.bincount(own.counts(batch.column(0))[1], minlength=len(found))
            n += batch.num_rows
        rows = [found[i : i + CHUNK] for i in range(0, len(found), CHUNK)]
        packed = [zlib.compress(r.tobytes(), 1) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(packed, pa.binary()), pa.array([n] * len(rows), pa.int64())], ["chunk", "counts", "docs"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, at = np.zeros(CHUNK, np.int64), 0, None
        for part in parts:
            for at, counts, docs in zip(*(part.column(j).to_pylist() for j in range(3)), strict=True):
                total, n = total + np.frombuffer(zlib.decompress(counts), np.int64), n + docs
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["chunk", "counts", "docs"])

    rows = docs.select("text").mapInArrow(fill, schema).groupBy("chunk").applyInArrow(add, schema).collect()
    rows.sort(key=lambda r: r["chunk"])
    sent.unpersist()
    df = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in rows)])
    return df[: len(vocabulary)], max([r["docs"] for r in rows], default=0)


def _model(docs: DataFrame, examples: DataFrame) -> Model:
    """The index of the examples (doc_id, label, text), with document counts over ``docs``."""
    found = examples.orderBy("doc_id").toArrow().combine_chunks()
    texts = found.column("text").chunk(0) if len(found) else pa.array([], pa.string())
    label, ids = found.column("label").to_numpy().astype(np.int64), found.column("doc_id").to_numpy()
    parts = (pc.unique(features(pieces(part)[1])[0]) for _, part in together(lowered(texts)))
    vocabulary = Vocabulary(pc.unique(pa.chunked_array(parts, pa.string())))
    give_back()
    begins, feature, counts = vocabulary.counts(texts)
    del found, texts
    give_back()
    n_features = len(vocabulary)
    gain = gains(np.bincount(feature, minlength=n_features).astype(float), np.bincount(feature, np.repeat(label.astype(np.int8), np.diff(begins)), n_features), max(1, len(ids)), int(label.sum()))
    give_back()
    df, n_docs = document_counts(docs, vocabulary)
    weights = np.log1p(n_docs / np.maximum(df, 1)) * np.sqrt(np.maximum(gain, LEAST_GAIN**2))
    return Model(vocabulary, weights, begins, feature, counts, label, ids)


def toxicity(docs: DataFrame, labels: DataFrame, holdout: tuple[int, int] | None = (5, 0), most_examples: int = 8000, row: str | None = None) -> DataFrame:
    """Score every whole text by its nearest labelled examples.

    labels: doc_id, label (0 or 1, nulls are left out; of several labels of a document the largest
    counts, of several texts with one doc_id the smallest). With ``holdout`` (n, r) the documents whose
    crc32(doc_id as text) modulo n is r are never learnt from. Returns for each row of ``docs``: doc_id,
    held_out, score (0 to 1), predicted (1 from 0.5 on) and evidence (doc_ids of the nearest examples,
    nearest first). A null or empty text, or one without any feature of the examples, gets the rate of
    label 1 among such examples; the same if there are no labels at all (0.25 then). ``row`` names a
    column with a number of each row, which is returned as row then. Other columns are not read.

    The examples are at most ``most_examples`` labelled documents, the first by a hash of their doc_id,
    with their whole texts; all of them and all their words and prefixes are in the index. A feature's
    weight is its tf-idf, with document counts over all of ``docs``, times the square root of its
    log-likelihood ratio with the label among the examples, so that neighbours are sought by what tells
    labels apart. The cosine is exact on these vectors. Votes are calibrated on the examples, each
    without itself. Three scans read the texts: one fetches the examples, one counts, one scores.
    """
    spark = docs.sparkSession
    n, r = holdout or (1, 1)
    known = labels.filter(crc_mod("doc_id", n) != r).filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_examples)
    examples = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").repartition(TASKS, "doc_id").groupBy("doc_id", "label").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    examples = keep(examples)
    model = _model(docs, examples)
    ids, some, base = np.sort(model.ids), len(model.ids) > 0, float(model.rest)
    sent = spark.sparkContext.broadcast(model)
    del model
    give_back()  # the driver has the index on disk now

    def alone() -> callable:
        own = sent.value

        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            votes, _ = own.votes(batch.column(0), np.searchsorted(ids, batch.column(1).to_numpy()).tolist())
            return pa.RecordBatch.from_arrays([pa.array(votes), batch.column(2)], ["vote", "label"])

        return of

    slope, shift, rest = 1.0, 0.0, 0.25
    if some:
        tried = arrow_map(examples.select("text", "doc_id", "label"), alone, "vote double, label int").toArrow()
        votes, marks = tried.column("vote").to_numpy(), tried.column("label").to_numpy().astype(float)
        use = ~np.isnan(votes)
        order = np.lexsort((marks[use], votes[use]))
        slope, shift = calibrate(votes[use][order], marks[use][order])
        rest = base
    examples.unpersist()

    def scan() -> callable:
        own = sent.value

        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            votes, near = own.votes(batch.column(1))
            scores = np.where(np.isnan(votes), rest, 1 / (1 + np.exp(-slope * logit(np.nan_to_num(votes)) - shift)))
            evidence = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in near])]).astype(np.int32)), pa.array(np.concatenate(near), pa.int64()))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), evidence, *batch.columns[3:]], ["doc_id", "held_out", "score", "predicted", "evidence", *own_row])

        return of

    own_row = ["row"] if row else []
    rows = docs.select("doc_id", "text", (crc_mod("doc_id", n) == r).alias("held_out"), *([row_id(row).alias("row")] if row else []))
    return arrow_map(rows, scan, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>" + ", row long" * len(own_row), LOOKED_UP)
