"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serieslab.llm.common import arrow_map, crc_mod, keep, numbered, splitmix
from serieslab.llm.words import lowered, pieces, together

#: Rows of the table of feature weights, which features share by hash.
ROWS = 1 << 16
#: Words of a block of a text in forward-backward.
BLOCK = 192
GRAMS, AFFIX = (2, 3, 4), (1, 2, 3, 4)


def word_features(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all words one after another, and where each word's begin.

    Features of a word (in UTF-8 bytes with a boundary mark at both ends): n-grams of 2 to 4 bytes,
    prefixes and suffixes of 1 to 4 bytes, and the whole word as its entry in the lexicon.
    """
    sizes = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    n, width = len(sizes), sizes + 2
    ends = np.cumsum(width)
    starts = ends - width
    data = np.full(int(width.sum()), 1, np.uint64)
    inner = np.ones(len(data), bool)
    inner[starts], inner[ends - 1] = False, False
    data[inner] = np.frombuffer(distinct.cast(pa.binary()).buffers()[2] or b"", np.uint8)[: int(sizes.sum())] if len(data) else data[inner]
    owner = np.repeat(np.arange(n), width)
    rows, owners = [], []

    def put(h: np.ndarray, kind: int, who: np.ndarray) -> None:
        rows.append((splitmix(h * np.uint64(31) + np.uint64(kind)) % np.uint64(ROWS)).astype(np.int32))
        owners.append(who)

    rolled = data.copy()
    for k in range(2, max(GRAMS) + 1):
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + data[k - 1 :]
        ok = owner[: len(rolled)] == owner[k - 1 :]
        put(rolled[ok], k, owner[: len(rolled)][ok])
    whole = np.zeros(n, np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(splitmix(data + (np.arange(len(data)) - starts[owner]).astype(np.uint64) * np.uint64(1 << 20)))])
    whole = sums[ends] - sums[starts]
    put(whole, 40, np.arange(n))
    for k in AFFIX:
        long = np.flatnonzero(sizes >= k)
        put(sums[starts[long] + 1 + k] - sums[starts[long]], 10 + k, long)
        tail = np.zeros(len(long), np.uint64)
        for j in range(k):
            tail = tail * np.uint64(0x100000001B3) + data[ends[long] - 1 - k + j]
        put(tail, 20 + k, long)
    rows_, owners_ = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners_, kind="stable")
    return rows_[order], np.searchsorted(owners_[order], np.arange(n + 1))


def emissions(weights: np.ndarray, rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Score of each label for each word: the mean of its features' weights times the root of their number."""
    sums = np.add.reduceat(weights[rows], begins[:-1], axis=0) if len(rows) else np.zeros((0, weights.shape[1]), np.float32)
    return (sums / np.sqrt(np.diff(begins))[:, None]).astype(np.float32)


def forward_backward(scores: np.ndarray, steps: np.ndarray, keep: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each label at each place, and expected transitions, of many padded rows at once.

    scores: (rows, length, labels); steps: transition scores; keep: which places are words. Padding
    passes a state on as it is. start and end: messages that reach the first and the last word of each
    row from the rest of its text (none by default).
    """
    n, length, labels = scores.shape
    move, local = _moves(scores, steps)
    ahead = np.empty_like(local)
    state = np.full((n, labels), 1 / labels, np.float32) if start is None else start
    for t in range(length):
        new = local[:, t] * (state @ move if t else state)
        new /= new.sum(axis=1, keepdims=True)
        state = np.where(keep[:, t, None], new, state)
        ahead[:, t] = state
    back = np.ones((n, labels), np.float32) if end is None else end
    pairs = np.zeros((labels, labels))
    for t in range(length - 1, -1, -1):
        if t < length - 1:
            inner = local[:, t + 1] * back
            joint = keep[:, t + 1] & keep[:, t]
            if end is None and joint.any():
                both = ahead[joint, t][:, :, None] * move * inner[joint][:, None, :]
                pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            new = inner @ move.T
            back = np.where(keep[:, t + 1, None], new / new.sum(axis=1, keepdims=True), back)
        ahead[:, t] *= back
    ahead /= np.maximum(ahead.sum(axis=2, keepdims=True), 1e-30)
    return ahead, pairs


def _moves(scores: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.exp(steps - steps.max()), np.exp(scores - scores.max(axis=2, keepdims=True))


def passages(scores: np.ndarray, steps: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """What each row does to a message that passes through it: a matrix of labels at its first and last word, up to a factor."""
    move, local = _moves(scores, steps)
    out = local[:, 0, :, None] * np.eye(scores.shape[2], dtype=np.float32)
    for t in range(1, scores.shape[1]):
        new = (out @ move) * local[:, t, None, :]
        new /= new.sum(axis=(1, 2), keepdims=True)
        out = np.where(keep[:, t, None, None], new, out)
    return out


def train(texts: pa.Array, labels: np.ndarray, n_labels: int, weights: np.ndarray, steps: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient ascent (Adagrad) of the conditional likelihood of labelled word sequences.

    Sequences of 64 words are put together from stretches of 8 to 32 words of shuffled texts, each
    stretch with the language of its text: code-switched text with known labels.
    """
    codes, distinct, offsets = pieces(texts)
    if not len(codes):
        return weights, steps
    rows, begins = word_features(distinct)
    rng = np.random.default_rng(seed)
    stretches = []
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        while a < b:
            n = int(rng.integers(8, 33))
            stretches.append((a, min(b, a + n), labels[i]))
            a += n
    grown, moved = np.full(weights.shape, 1e-2, np.float32), np.full(steps.shape, 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(stretches))
        flat = np.concatenate([np.arange(*stretches[i][:2]) for i in order])
        gold = np.concatenate([np.full(stretches[i][1] - stretches[i][0], stretches[i][2]) for i in order])
        for at in range(0, len(flat), 64 * 256):
            part, right = codes[flat[at : at + 64 * 256]], gold[at : at + 64 * 256]
            n = -(-len(part) // 64)
            keep = np.zeros(n * 64, bool)
            keep[: len(part)] = True
            own, back = np.unique(part, return_inverse=True)
            lengths = np.diff(begins)[own]
            used = rows[np.repeat(begins[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
            own_begins = np.concatenate([[0], np.cumsum(lengths)])
            scores = np.zeros((n * 64, n_labels), np.float32)
            scores[: len(part)] = emissions(weights, used, own_begins)[back]
            posterior, pairs = forward_backward(scores.reshape(n, 64, -1), steps.astype(np.float32), keep.reshape(n, 64))
            error = -posterior.reshape(-1, n_labels)[: len(part)]
            error[np.arange(len(part)), right] += 1
            per_word = np.zeros((len(own), n_labels), np.float32)
            np.add.at(per_word, back, error)
            per_word /= np.sqrt(lengths)[:, None]
            touched, place = np.unique(used, return_inverse=True)
            grad = np.zeros((len(touched), n_labels), np.float32)
            np.add.at(grad, place, np.repeat(per_word, lengths, axis=0))
            grad -= 1e-3 * weights[touched]
            grown[touched] += grad * grad
            weights[touched] += 0.2 * grad / np.sqrt(grown[touched])
            seen = np.zeros(steps.shape)
            inside = np.flatnonzero((np.arange(len(part) - 1) + 1) % 64)
            np.add.at(seen, (right[inside], right[inside + 1]), 1)
            grad = seen - pairs - 1e-2 * steps
            moved += grad * grad
            steps = steps + 0.2 * grad / np.sqrt(moved)
    return weights, steps


def _shard_trainer(start: Broadcast, n_labels: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            share = pa.Table.from_batches(parts).combine_chunks()
            weights, steps = (x.copy() for x in start.value)
            weights, steps = train(lowered(share.column("text").chunk(0)), share.column("y").to_numpy(), n_labels, weights, steps, 2, seed + share.column("shard")[0].as_py())
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([steps.tobytes()], pa.binary())], ["w", "s"])

    return shard


def fit(labelled: DataFrame, most_per_language: int = 1500, shards: int = 4, rounds: int = 2) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, feature weights, transitions) learnt from ``labelled`` (row, a number of each row; text, lang).

    At most ``most_per_language`` documents of each language are used, the first by a hash of the row
    number; the number of languages is bounded by their list, which is collected. Tasks train on
    ``shards`` shares of the sample from the same start and their weights are averaged, ``rounds`` times.
    """
    known = labelled.filter("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((ROWS, 1), np.float32), np.zeros((1, 1))
    place = F.pmod(F.xxhash64("row"), F.lit(1 << 30))
    sizes = F.broadcast(labelled.sparkSession.createDataFrame([(s, n) for s, n in counts.items()], "lang string, n long"))
    # about twice as many as are wanted pass by their hash, so no language is ranked whole in one task
    share = place / float(1 << 30) * F.col("n")
    near = known.join(sizes, "lang").filter(share <= 2 * most_per_language + 100).select("row", "lang", place.alias("h"))
    chosen = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "row"))).filter(F.col("k") <= most_per_language)
    number = F.create_map(*[x for i, s in enumerate(languages) for x in (F.lit(s), F.lit(i))])
    chosen = chosen.select("row", "k", number[F.col("lang")].alias("y"), (F.col("k") % shards).cast("int").alias("shard"))
    sample = known.select("row", "text").join(F.broadcast(chosen), "row").select("shard", "k", "y", "text")
    sample = keep(sample.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "k", "y"))
    weights, steps, n = np.zeros((ROWS, len(languages)), np.float32), np.zeros((len(languages), len(languages))), len(languages)
    for k in range(rounds):
        start = labelled.sparkSession.sparkContext.broadcast((weights, steps))
        parts = sample.mapInArrow(_shard_trainer(start, n, 17 * k), "w binary, s binary").collect()  # one model a shard
        weights = np.mean([np.frombuffer(p["w"], np.float32).reshape(weights.shape) for p in parts], axis=0, dtype=np.float32)
        steps = np.mean([np.frombuffer(p["s"]).reshape(steps.shape) for p in parts], axis=0)
        start.unpersist()
    sample.unpersist()
    return languages, weights, steps


def posteriors(codes: np.ndarray, offsets: np.ndarray, emitted: np.ndarray, steps: np.ndarray, together: int = 2048) -> np.ndarray:
    """Posterior label distribution of every word of some texts, exactly.

    Texts are cut into blocks of BLOCK words, which run side by side. For texts of several blocks a
    first pass finds what each block does to a message; messages then go from block to block in both
    directions, and the second pass starts each block from those that reach it.
    """
    counts, labels = np.diff(offsets), emitted.shape[1]
    blocks = -(-counts // BLOCK)
    begins = np.cumsum(blocks) - blocks
    text = np.repeat(np.arange(len(counts)), blocks)
    low = offsets[:-1][text] + (np.arange(len(text)) - begins[text]) * BLOCK
    size = np.minimum(low + BLOCK, offsets[1:][text]) - low

    def parts(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        rows = rows[np.argsort(size[rows], kind="stable")]
        for i in range(0, len(rows), together):
            own = rows[i : i + together]
            place = np.arange(int(size[own].max()))
            at, keep = low[own][:, None] + place, place < size[own][:, None]
            yield own, at, keep, emitted[codes[np.where(keep, at, 0)]]

    start, end = np.full((len(text), labels), 1 / labels, np.float32), np.ones((len(text), labels), np.float32)
    through, move = np.empty((len(text), labels, labels), np.float32), np.exp(steps - steps.max())
    for own, _, keep, scores in parts(np.flatnonzero(blocks[text] > 1)):
        through[own] = passages(scores, steps, keep)
    for k in range(1, int(blocks.max(initial=0))):
        at = begins[blocks > k] + k
        new = np.einsum("ni,nij->nj", start[at - 1], through[at - 1]) @ move
        start[at] = new / new.sum(axis=1, keepdims=True)
    for k in range(int(blocks.max(initial=0)) - 1, 0, -1):
        at = begins[blocks > k] + k
        new = np.einsum("nij,nj->ni", through[at], end[at]) @ move.T
        end[at - 1] = new / new.sum(axis=1, keepdims=True)
    out = np.empty((len(codes), labels), np.float32)
    for own, at, keep, scores in parts(np.arange(len(text))):
        out[at[keep]] = forward_backward(scores, steps, keep, start[own], end[own])[0][keep]
    return out


def identify(docs: DataFrame, holdout: tuple[int, int] | None = (4, 2), **bounds: int) -> DataFrame:
    """The language of every whole text, from the posteriors of its words.

    Learns from text and non-null lang of documents whose crc32(doc_id as text) modulo n is not r, where
    ``holdout`` is (n, r); a prediction uses the text alone. Returns for each row of ``docs``: doc_id,
    held_out, lang_pred (``und`` for a null text, one without letters, and if no language is known),
    score (the mean posterior of that language over the words that have letters; 0 for ``und``) and
    shares (that mean for each language, for code-switched texts). Of equal means the language that is
    first by code point wins. Rows that share a doc_id, or have none, are documents of their own. Other
    columns are not read.
    """
    n, r = holdout or (1, 1)
    labelled = numbered(docs, "row", ["doc_id", "text", "lang"]).filter(crc_mod("doc_id", n) != r).select("row", "text", "lang")
    languages, weights, steps = fit(labelled, **bounds)
    sent = docs.sparkSession.sparkContext.broadcast((weights, steps.astype(np.float32)))

    def scan() -> callable:
        own, move = sent.value

        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_docs = batch.num_rows
            share, n_counted = np.zeros((n_docs, max(1, len(languages)))), np.zeros(n_docs, np.int64)
            for first, part in together(lowered(batch.column(1))):
                codes, distinct, offsets = pieces(part)
                if not len(codes):
                    continue
                counted = pc.match_substring_regex(distinct, r"\p{L}").to_numpy(zero_copy_only=False)[codes]
                n_counted[first : first + len(part)] = np.diff(np.concatenate([[0], np.cumsum(counted)])[offsets])
                if languages:
                    found = posteriors(codes, offsets, emissions(own, *word_features(distinct)), move) * counted[:, None]
                    sums = np.concatenate([np.zeros((1, found.shape[1])), np.cumsum(found, axis=0, dtype=np.float64)])
                    share[first : first + len(part)] = sums[offsets[1:]] - sums[offsets[:-1]]
            share = np.clip(share / np.maximum(n_counted, 1)[:, None], 0, 1)
            best = share.argmax(axis=1)
            und = (n_counted == 0) | (not languages)
            names = [None if u else languages[b] for u, b in zip(und, best, strict=True)]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pc.fill_null(pa.array(names, pa.string()), "und"), pa.array(np.where(und, 0.0, share[np.arange(n_docs), best])), pa.array([None if u else s for u, s in zip(und, share.tolist(), strict=True)], pa.list_(pa.float64()))],
                ["doc_id", "held_out", "lang_pred", "score", "shares"],
            )

        return of

    rows = docs.select("doc_id", "text", (crc_mod("doc_id", n) == r).alias("held_out"))
    return arrow_map(rows, scan, "doc_id long, held_out boolean, lang_pred string, score double, shares array<double>")
