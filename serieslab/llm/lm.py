"""Language-model scores: a causal self-attention model in numpy over subword ids, and a word unigram base."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslab.llm.common import BATCH_BYTES, arrow_map, crc_mod, materialise, row_id
from serieslab.llm.tokens import encoder, ragged
from serieslab.llm.words import lowered, pieces, together

#: Window of the attention, tokens of it that are context of the ones scored, and width of the model.
WINDOW, OVERLAP, WIDTH = 32, 8, 16
#: Token ranks with tables of their own, output classes, and ids of the tokenizer with the end of a text.
RANKS, CLASSES, END = 2048, 64, 49408
IDS = END + 1
#: Added to counts: of a class after a token, and of a token within its class after a token.
PULL, HOLD = 2.0, 4.0
#: Windows of one gradient step, and bytes of texts whose distinct words are counted and looked up at once.
STEP, LOOKED_UP = 256, 4 * BATCH_BYTES


class Tables:
    """What the model reads from corpus counts: classes of tokens, and both factors of the next token after the last.

    p(token | text) = p(class | text) * p(token | class, last token). The attention adds to the
    logarithm of p(class | last token), which comes from counts over all training documents; the
    second factor is counts alone, drawn to p(token | class).
    """

    def __init__(self, unigrams: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """unigrams: count of each id; pairs: ranks of a token and the next one, and how often."""
        order = np.argsort(-unigrams, kind="stable")
        self.rank = self.ranks(unigrams)
        last, nxt, n = pairs
        counts = np.zeros((RANKS + 1, RANKS + 1), np.float32)
        counts[last, nxt] = n
        classes = np.append(cluster(counts[:RANKS, :RANKS]), CLASSES - 1)  # ids without a rank share the last class
        self.class_of_id = classes[self.rank].astype(np.int16)
        smooth = unigrams + 0.1
        self.in_class = np.log(smooth / np.bincount(self.class_of_id, weights=smooth, minlength=CLASSES)[self.class_of_id]).astype(np.float32)
        after = np.zeros((RANKS + 1, CLASSES), np.float32)
        np.add.at(after.T, classes, counts.T)
        prior = (np.bincount(self.class_of_id, weights=smooth, minlength=CLASSES) / smooth.sum()).astype(np.float32)
        share = (after + PULL * prior) / (after.sum(axis=1, keepdims=True) + PULL)
        self.skip = np.log(np.maximum(share, 1e-30)).astype(np.float32)  # a class may have no id at all
        self.held = np.log(HOLD / (after + HOLD)).astype(np.float32)
        own = np.exp(self.in_class)[order[:RANKS]]
        self.next = np.log((counts[:, :RANKS] + HOLD * own) / (after[:, classes[:RANKS]] + HOLD)).astype(np.float16)

    @staticmethod
    def ranks(unigrams: np.ndarray) -> np.ndarray:
        """Place of each id by falling count; RANKS for all those after the first RANKS."""
        out = np.full(IDS, RANKS, np.int32)
        out[np.argsort(-unigrams, kind="stable")[:RANKS]] = np.arange(RANKS)
        return out

    def within(self, last: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log p(token | its class, the token before it)."""
        rank = self.rank[ids]
        out = self.held[last, self.class_of_id[ids]] + self.in_class[ids]
        known = rank < RANKS
        out[known] = self.next[last[known], rank[known]]
        return out


def cluster(counts: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Classes (all but the last) of tokens with alike tokens before them: spherical k-means of square-root shares."""
    total = counts.sum(axis=0)
    rows = np.sqrt(counts[:512].T / np.maximum(total, 1)[:, None])
    n = min(CLASSES - 1, len(rows))
    centres = rows[:n].copy()
    label = np.zeros(len(rows), np.int64)
    for _ in range(rounds):
        label = (rows @ centres.T).argmax(axis=1)
        for c in range(n):
            mean = (rows[label == c] * total[label == c, None]).sum(axis=0)
            if mean.any():
                centres[c] = mean / np.linalg.norm(mean)
    return label


def start_weights(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    return {"tokens": draw(RANKS + 1, WIDTH, by=0.3), "places": draw(WINDOW, WIDTH, by=0.3), "q": draw(WIDTH, WIDTH, by=0.25), "k": draw(WIDTH, WIDTH, by=0.25), "v": draw(WIDTH, WIDTH, by=0.25), "out": np.zeros((WIDTH, CLASSES), np.float32)}


_MASK = np.where(np.tril(np.ones((WINDOW, WINDOW), bool)), 0, -1e9).astype(np.float32)
_CAUSAL = np.exp(_MASK)
_ONES = np.ones(CLASSES, np.float32)


def attend(w: dict[str, np.ndarray], last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Masked attention over windows of ranks (n, WINDOW): inputs, queries, keys, values, weights and their mix."""
    x = w["tokens"][last] + w["places"]
    flat = x.reshape(-1, WIDTH)
    q, k, v = ((flat @ w[name]).reshape(x.shape) for name in "qkv")
    a = q @ k.transpose(0, 2, 1)
    a *= np.float32(WIDTH**-0.5)
    a += _MASK
    np.exp(a - a.max(axis=2, keepdims=True), out=a)
    a /= a.sum(axis=2, keepdims=True)
    return x, q, k, v, a, a @ v


def class_logs(w: dict[str, np.ndarray], tables: Tables, mixed: np.ndarray, last: np.ndarray) -> np.ndarray:
    """log p(class) for each row of the attention's mix, with the token before."""
    logits = mixed @ w["out"]
    logits += tables.skip[last]
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over texts of so many tokens: text, first token, and first token to score.

    A text's first window scores all its tokens, each later one those after its OVERLAP tokens of
    context, so every token is scored once.
    """
    step = WINDOW - OVERLAP
    n = np.maximum(1, -(-(sizes - OVERLAP) // step))
    text = np.repeat(np.arange(len(sizes)), n)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, number * step, np.where(number > 0, number * step + OVERLAP, 0)


def _inputs(tables: Tables, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rank of the token before each; before a text's first token stands the end of the one before."""
    last = np.empty(len(ids), np.int32)
    last[1:] = tables.rank[ids[:-1]]
    starts = np.cumsum(sizes) - sizes
    last[starts[sizes > 0]] = tables.rank[END]
    return last


def score_ids(w: dict[str, np.ndarray], tables: Tables, ids: np.ndarray, sizes: np.ndarray, together: int = 128) -> np.ndarray:
    """log p of each text, a sequence of ids that ends with END.

    Windows are worked out as in :func:`attend` in batches. The embeddings have been put through the projections
    once for all tokens and all places, and the sums of the softmax come out of one product with the
    values, which have a one beside them, so nothing runs over the attention weights but one exponential.
    Tokens that are context of a later window are keys and values there, and no queries.
    """
    last, starts = _inputs(tables, ids, sizes), np.cumsum(sizes) - sizes
    logs = tables.within(last, ids)
    text, first, scored = windows(sizes)
    low, size = starts[text] + first, np.minimum(sizes[text] - first, WINDOW)
    padded = np.append(last, np.zeros(WINDOW, np.int32))
    scaled = np.concatenate([w["q"] * np.float32(WIDTH**-0.5), w["k"], w["v"], np.zeros((WIDTH, 1), np.float32)], axis=1)
    by_token, by_place = w["tokens"] @ scaled, w["places"] @ scaled
    by_token[:, -1] = 1
    place, classes = np.arange(WINDOW), tables.class_of_id[ids]
    for skip in (0, OVERLAP):
        own = np.flatnonzero(scored - first == skip)
        for i in range(0, len(own), together):
            part = own[i : i + together]
            at = low[part, None] + place
            qkv = by_token.take(padded.take(at), axis=0)
            qkv += by_place
            weights = qkv[:, skip:, :WIDTH] @ qkv[:, :, WIDTH : 2 * WIDTH].transpose(0, 2, 1)
            np.exp(np.minimum(weights, 60, out=weights), out=weights)
            weights *= _CAUSAL[skip:]
            mixed = (weights @ qkv[:, :, 2 * WIDTH :]).reshape(-1, WIDTH + 1)
            used = np.flatnonzero(place[skip:] < size[part, None])
            mixed, where = mixed.take(used, axis=0), at[:, skip:].ravel().take(used)
            logits = (mixed[:, :WIDTH] / mixed[:, WIDTH:]) @ w["out"]
            logits += tables.skip.take(last.take(where), axis=0)
            right = logits.ravel().take(np.arange(0, logits.size, CLASSES) + classes.take(where))
            logs[where] += right - np.log(np.exp(logits, out=logits) @ _ONES)
    sums = np.concatenate([[0.0], np.cumsum(logs, dtype=np.float64)])
    return sums[starts + sizes] - sums[starts]


def gradient(w: dict[str, np.ndarray], tables: Tables, last: np.ndarray, target: np.ndarray, use: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the log-likelihood of the classes ``target`` of windows, over the places in ``use``.

    As in :func:`score_ids` the embeddings go through the projections before windows are looked up, and
    the weights stay unnormalised: a column of ones in the values gives their sums, and on the way back
    one product gives the derivative of the weights less its mean. One exponential a class and place
    gives the shares of the classes. Derivatives go back through the projections before they are summed
    by token, as the embedding is narrower than the three projections of it.
    """
    scale = np.float32(WIDTH**-0.5)
    scaled = np.concatenate([w["q"] * scale, w["k"], w["v"]], axis=1)
    qkv = (w["tokens"] @ scaled).take(last, axis=0)
    qkv += w["places"] @ scaled
    q, k = qkv[:, :, :WIDTH], qkv[:, :, WIDTH : 2 * WIDTH]
    values = np.ones((*last.shape, WIDTH + 1), np.float32)
    values[:, :, :WIDTH] = qkv[:, :, 2 * WIDTH :]
    a = q @ k.transpose(0, 2, 1)
    np.exp(np.minimum(a, 60, out=a), out=a)
    a *= _CAUSAL
    at = np.flatnonzero(use)
    mixed = (a @ values).reshape(-1, WIDTH + 1).take(at, axis=0)
    sums = mixed[:, WIDTH:]
    mixed = mixed[:, :WIDTH] / sums
    error = mixed @ w["out"]
    error += tables.skip.take(last.ravel().take(at), axis=0)
    np.exp(np.minimum(error, 60, out=error), out=error)
    error *= -1 / error.sum(axis=1, keepdims=True)
    error.ravel()[np.arange(0, error.size, CLASSES) + target.ravel().take(at)] += 1
    g = {"out": mixed.T @ error}
    d_mix = np.empty((len(at), WIDTH + 1), np.float32)
    np.matmul(error, w["out"].T, out=d_mix[:, :WIDTH])
    d_mix[:, WIDTH] = -np.einsum("ij,ij->i", d_mix[:, :WIDTH], mixed)
    d_mix /= sums
    back = np.zeros_like(values)
    back.reshape(-1, WIDTH + 1)[at] = d_mix
    d = np.empty_like(qkv)
    d[:, :, 2 * WIDTH :] = a.transpose(0, 2, 1) @ back[:, :, :WIDTH]
    a *= back @ values.transpose(0, 2, 1)
    d[:, :, :WIDTH] = a @ k
    d[:, :, WIDTH : 2 * WIDTH] = a.transpose(0, 2, 1) @ q
    flat, rows = last.ravel(), d.reshape(-1, 3 * WIDTH)
    order = np.argsort(flat.astype(np.uint16), kind="stable")
    begin = np.flatnonzero(np.diff(flat.take(order), prepend=-1))
    g["tokens"] = np.zeros_like(w["tokens"])
    g["tokens"][flat.take(order.take(begin))] = np.add.reduceat((rows @ scaled.T).take(order, axis=0), begin)
    by_place = d.sum(axis=0)
    g["places"] = by_place @ scaled.T
    projections = w["tokens"].take(flat, axis=0).T @ rows + w["places"].T @ by_place
    g["q"], g["k"], g["v"] = projections[:, :WIDTH] * scale, projections[:, WIDTH : 2 * WIDTH], projections[:, 2 * WIDTH :]
    return g


def train_part(w: dict[str, np.ndarray], tables: Tables, batches: Iterator[tuple[np.ndarray, np.ndarray]], seed: int, rate: float, together: int = STEP) -> tuple[dict[str, np.ndarray], int]:
    """Adam steps from ``w`` over all windows of the texts, each token once; the new weights and the number of steps."""
    w = {name: x.copy() for name, x in w.items()}
    mean, square, steps = {n: np.zeros_like(x) for n, x in w.items()}, {n: np.zeros_like(x) for n, x in w.items()}, 0
    place = np.arange(WINDOW)
    for ids, sizes in batches:
        last, starts = np.append(_inputs(tables, ids, sizes), np.zeros(WINDOW, np.int32)), np.cumsum(sizes) - sizes
        classes = np.append(tables.class_of_id[ids], np.zeros(WINDOW, np.int16))
        text, first, scored = windows(sizes)
        order = np.random.default_rng(seed).permutation(len(text))
        low, skip, size = (starts[text] + first)[order], (scored - first)[order], (sizes[text] - first)[order]
        for i in range(0, len(order), together):
            part = slice(i, i + together)
            at = low[part, None] + place
            use = (place >= skip[part, None]) & (place < size[part, None])
            g = gradient(w, tables, last[at], classes[at], use)
            steps += 1
            for name, x in g.items():
                x /= use.sum()
                mean[name] += 0.1 * (x - mean[name])
                square[name] += 0.01 * (x * x - square[name])
                w[name] += rate * (mean[name] / (1 - 0.9**steps)) / (np.sqrt(square[name] / (1 - 0.99**steps)) + 1e-6)
    return w, steps


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[name].ravel() for name in sorted(w)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name in sorted(like):
        out[name] = flat[at : at + like[name].size].reshape(like[name].shape).astype(np.float32)
        at += like[name].size
    return out


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after another and the number in each, from little-endian 16-bit integers."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").astype(np.int64), sizes


def _trainer(sent: Broadcast, seed: int, rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, tables = sent.value
        new, steps = train_part(w, tables, (_ids(b.column(0)) for b in batches if b.num_rows), seed, rate)
        yield pa.RecordBatch.from_arrays([pa.array([_flat(new).tobytes()], pa.binary()), pa.array([steps], pa.int64())], ["w", "steps"])

    return train


def _average(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of several tasks, averaged by their number of steps."""
    total, steps = None, 0
    for part in parts:
        for w, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            if n:
                w = np.frombuffer(w, np.float32).astype(np.float64) * n
                total, steps = w if total is None else total + w, steps + n
    if steps:
        yield pa.RecordBatch.from_arrays([pa.array([(total / steps).astype(np.float32).tobytes()], pa.binary()), pa.array([steps], pa.int64())], ["w", "steps"])


def train(texts: DataFrame, tables: Tables, rounds: int = 2) -> dict[str, np.ndarray]:
    """Attention weights from the training texts (column ids): local steps in every task, then averaged.

    Tasks average in groups of 16, group after group, so no task and not the driver receives more than
    that many models at once. Every window of every training text is learnt from in every round, in an order of its own.
    """
    spark, w = texts.sparkSession, start_weights()
    for k in range(rounds):
        sent = spark.sparkContext.broadcast((w, tables))
        parts = texts.select("ids").mapInArrow(_trainer(sent, k, 0.01 if k == 0 else 0.004), "w binary, steps long")
        n = texts.rdd.getNumPartitions()
        while n > 1:
            n = -(-n // 16)
            parts = parts.repartition(n).mapInArrow(_average, "w binary, steps long")
        found = parts.collect()
        if found:
            w = _shaped(np.frombuffer(found[0]["w"], np.float32), w)
        sent.unpersist()
    return w


def lm_score(docs: DataFrame, tokenizer_path: str, holdout: tuple[int, int] | None = (10, 0), common_words: int = 300_000) -> DataFrame:
    """Score every whole text by a causal self-attention model, and by a word unigram base.

    Learns from documents whose crc32(doc_id as text) modulo n is not r, where ``holdout`` is (n, r).
    A-Z are lower-cased; a text is its words ``[^\\x20\\x09-\\x0D]+`` and one end, which counts as a
    token. Returns for each row of ``docs``: doc_id, held_out, n_tokens, n_known (tokens with a count
    in training), train_tokens, base_score (sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))))
    and score (the model's log10 probability of the subwords of the text and its end). A null text
    counts as empty and is its end alone. Other columns are not read.

    Counts cover all training documents: words by one aggregation, subword pairs by another over ranks
    (at most RANKS**2 sums reach the driver). The ``common_words`` commonest words are broadcast with
    their counts; a document's other words are joined by word, so the vocabulary may be of any size.
    The scan that encodes the texts writes 16-bit subword ids; training and scoring read those.
    """
    spark = docs.sparkSession
    n, r = holdout or (1, 1)
    base = docs.select(row_id().alias("row"), "doc_id", "text", (crc_mod("doc_id", n) == r).alias("held_out"))

    def words() -> callable:
        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            codes, distinct, _ = pieces(lowered(batch.column(0)))
            counts = np.bincount(codes, minlength=len(distinct))
            return pa.RecordBatch.from_arrays([distinct, pa.array(counts)], ["word", "c"]).filter(pa.array(counts > 0))

        return of

    training = base.filter(~F.col("held_out"))
    counted = materialise(arrow_map(training.select("text"), words, "word string, c long", LOOKED_UP).groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    totals = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = training.count()
    size, distinct_words = totals[0] + ends, totals[1] + (ends > 0)
    common = counted.orderBy(F.desc("c"), "word").limit(common_words).toArrow()
    sent = spark.sparkContext.broadcast((common.column("word").combine_chunks(), common.column("c").to_numpy()))
    end_log = float(np.log10((ends + 0.1) / (size + 0.1 * (distinct_words + 1))))

    def log_of(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (size + 0.1 * (distinct_words + 1)))

    def encode() -> callable:
        known, counts = sent.value
        logs, coder = log_of(counts), encoder(tokenizer_path)

        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            codes, distinct, offsets = pieces(lowered(batch.column(2)))
            at = pc.fill_null(pc.index_in(distinct, value_set=known), -1).to_numpy(zero_copy_only=False) if len(known) else np.full(len(distinct), -1)
            word_logs = np.where(at >= 0, np.append(logs, 0.0)[at], 0.0)
            sums = np.concatenate([[0.0], np.cumsum(word_logs[codes])])
            n_known = np.concatenate([[0], np.cumsum((at >= 0)[codes])])
            rare_at = np.flatnonzero((at < 0)[codes])
            rare_offsets = np.searchsorted(rare_at, offsets)
            rare = pa.ListArray.from_arrays(pa.array(rare_offsets.astype(np.int32)), distinct.take(pa.array(codes[rare_at])))
            own, per_word = coder.of_pieces(distinct)
            ids = ragged(own, (np.cumsum(per_word) - per_word)[codes], per_word[codes])
            per_text = np.diff(np.concatenate([[0], np.cumsum(per_word[codes])])[offsets])
            ids = np.insert(ids, np.cumsum(per_text), END).astype("<u2").tobytes()
            ends_at = np.concatenate([[0], np.cumsum(per_text + 1)]) * 2
            binary = pa.array([ids[a:b] for a, b in zip(ends_at[:-1], ends_at[1:], strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(np.diff(offsets) + 1), pa.array(np.diff(n_known[offsets])), pa.array(np.diff(sums[offsets])), rare, binary], ["row", "doc_id", "held_out", "n_tokens", "n_common", "common_log", "rare", "ids"])

        return of

    coded = arrow_map(base.select("row", "doc_id", "text", "held_out"), encode, "row long, doc_id long, held_out boolean, n_tokens long, n_common long, common_log double, rare array<string>, ids binary", LOOKED_UP)
    coded = materialise(coded, "subwords")

    # words outside the common ones: known or not, and their logarithms
    rare = coded.select("row", F.explode("rare").alias("word")).join(counted, "word", "left")
    per_token = F.log10((F.coalesce(F.col("c"), F.lit(0)) + 0.1) / (size + 0.1 * (distinct_words + 1)))
    rare = rare.groupBy("row").agg(F.sum(per_token).alias("rare_log"), F.count("c").alias("n_rare"))

    # counts of subwords and of pairs of ranked subwords, over all training documents
    texts = coded.filter(~F.col("held_out")).select("ids")

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(IDS, np.int64)
        for batch in batches:
            total += np.bincount(_ids(batch.column(0))[0], minlength=IDS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    found = texts.mapInArrow(singles, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    unigrams = np.zeros(IDS)
    unigrams[found.column("id").to_numpy()] = found.column("n").to_numpy()
    ranks = Tables.ranks(unigrams)

    def pairs() -> callable:
        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, sizes = _ids(batch.column(0))
            last = np.empty(len(ids), np.int64)
            last[1:] = ranks[ids[:-1]]
            last[(np.cumsum(sizes) - sizes)[sizes > 0]] = ranks[END]
            key, count = np.unique((last * (RANKS + 1) + ranks[ids]).astype(np.int32), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], ["pair", "n"])

        return of

    table = arrow_map(texts, pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    key = table.column("pair").to_numpy()
    tables = Tables(unigrams, (key // (RANKS + 1), key % (RANKS + 1), table.column("n").to_numpy()))
    model = spark.sparkContext.broadcast((train(texts, tables), tables))

    def scan() -> callable:
        own, counts = model.value

        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, sizes = _ids(batch.column(1))
            return pa.RecordBatch.from_arrays([*(batch.column(j) for j in (0, 2, 3, 4, 5, 6)), pa.array(score_ids(own, counts, ids, sizes) / np.log(10))], ["row", "doc_id", "held_out", "n_tokens", "n_common", "common_log", "score"])

        return of

    scored = arrow_map(coded.select("row", "ids", "doc_id", "held_out", "n_tokens", "n_common", "common_log"), scan, "row long, doc_id long, held_out boolean, n_tokens long, n_common long, common_log double, score double")
    zero = F.lit(0)
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + F.coalesce("n_rare", zero) + F.lit(int(ends > 0))).alias("n_known"), F.lit(size).cast("long").alias("train_tokens"),
        (F.col("common_log") + F.coalesce("rare_log", F.lit(0.0)) + F.lit(end_log)).alias("base_score"), "score",
    )
