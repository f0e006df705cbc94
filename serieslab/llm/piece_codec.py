"""Ids of SentencePiece vocabularies of the merge type, and texts from ids, checked against the library itself."""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator
from itertools import chain, groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from serieslab.llm.common import arrow_map
from serieslab.llm.words import together

# Fixed values of the format: how a blank is written, what an unknown piece decodes to, and what stands for a byte that is no text.
BLANK, UNKNOWN, NO_TEXT = "▁", " ⁇ ", "�"
MERGE_TYPE = 2
#: Chunks and parts whose ids a task keeps, and characters of a long text that are cut into chunks at a time.
REMEMBERED, STRETCH = 500_000, 1 << 20
#: Symbols of a part up to which it is merged in a table with others, and the cost there of a pair that is no piece.
FEW, NEVER = 48, 1e30

codecs.register_error("a mark for each byte", lambda e: (NO_TEXT * (e.end - e.start), e.end))


def ragged(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` that ``codes`` number, one after another."""
    own = sizes[codes]
    ends = np.cumsum(own)
    return flat[np.repeat(begins[codes] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)]


class Spelt:
    """Ids of texts that a task remembers: the number of each text, and the ids of all one after another."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.begins, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def new(self, texts: list[str]) -> list[str]:
        """Those of the distinct texts that are not known. When too many would be, only the known ones of these stay."""
        if len(self.number) + len(texts) > REMEMBERED:
            stay = [t for t in texts if t in self.number]
            flat, sizes = self.of(stay)
            self.__init__()
            self.add(stay, flat, sizes)
        return [t for t in texts if t not in self.number]

    def add(self, texts: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.number.update(zip(texts, range(len(self.number), len(self.number) + len(texts)), strict=True))
        self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])

    def of(self, texts: list[str], codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the known texts, or of those that ``codes`` number, one after another, and how many each has."""
        numbers = np.fromiter(map(self.number.__getitem__, texts), np.int64, len(texts))
        if codes is not None:
            numbers = numbers[codes]
        return ragged(self.flat, self.begins, self.sizes, numbers), self.sizes[numbers]


class PieceCodec:
    """A vocabulary of the merge type with byte fallback, as its model file describes it.

    A text is written with ``BLANK`` for each blank, and one more in front if the model says so. Its
    symbols, characters at first, are joined pair by pair: an agenda holds the neighbours whose
    joint text is a piece, the highest score first and of equal ones the leftmost; joining two puts their new
    pairs with the symbols at both sides on the agenda. What is no piece in the end becomes its bytes. The agendas of
    many short parts are the rows of a table; a long part has a heap.

    Two characters that stand side by side in no piece are never joined, whatever is around them, so a text may be cut
    between them and each distinct part encoded once. In usual vocabularies a blank after another
    character is such a place: texts are cut into chunks there, and chunks that are new into parts at all
    other such places. Where a vocabulary has a piece with a blank after another character (it is looked up), a
    text is one chunk.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if model.trainer_spec.model_type != MERGE_TYPE or not model.trainer_spec.byte_fallback or any(p.type in (kinds.UNUSED, kinds.USER_DEFINED) for p in model.pieces):
            raise ValueError("only vocabularies of the merge type with byte fallback, without unused or user-defined pieces")
        self.plain, self.dummy = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces, rules.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.cost = {p.piece: -p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.of_byte = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.surface = [self._surface(p, kinds) for p in model.pieces]
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.begins = {i for p, i in self.ids.items() if p[0] == BLANK}
        self.beside = {a + b for p in self.ids for a, b in pairwise(p)}
        crosses = any(p[0] != BLANK and p[1] == BLANK for p in self.beside)
        self.chunk = re.compile("(?s).+" if crosses else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.cut = None if crosses else re.compile(f"[^{BLANK}]{BLANK}")
        self.by_word = self.plain and self.dummy and not crosses
        self.known, self.parts = Spelt(), Spelt()
        self.of_letter = np.full(0x110000, -1, np.int32)
        for letter, i in self.ids.items():
            if len(letter) == 1:
                self.of_letter[ord(letter)] = i
        self.pairs = self._pairs()
        self.meet = np.array(sorted(ord(a) << 21 | ord(b) for a, b in self.beside), np.int64)
        self.meet_ascii = np.array([chr(a) + chr(b) in self.beside for a in range(128) for b in range(128)])

    @staticmethod
    def _surface(piece: object, kinds: object) -> bytes:
        if piece.type == kinds.BYTE:
            return bytes([int(piece.piece[3:5], 16)])
        return {kinds.CONTROL: b"", kinds.UNKNOWN: UNKNOWN.encode()}.get(piece.type, piece.piece.replace(BLANK, " ").encode())

    def written(self, text: str) -> str:
        """The text as its symbols are taken from it."""
        if not self.plain:
            return self.library.normalize(text)
        return (BLANK if self.dummy and text else "") + text.replace(" ", BLANK)

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of two pieces that together form a piece, as one sorted key each, with its cost (a score has 32 bits) and number."""
        size, found = len(self.surface), {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    found[a * size + b] = (self.cost[piece], i)
        keys = np.array(sorted(found), np.int64)
        return keys, np.array([found[k][0] for k in keys.tolist()], np.float32), np.array([found[k][1] for k in keys.tolist()], np.int32)

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and number of the piece of each pair; NEVER without one, or beyond the end (-1)."""
        keys, costs, joint = self.pairs
        key = a.astype(np.int64) * len(self.surface) + b
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        has = (keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(has, costs[at], NEVER), joint[at]

    def merge_all(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts one after another and how many each has: each row of a table is a part with its agenda, and in each step every part joins its cheapest pair."""
        letters = np.fromiter(map(len, parts), np.int64, len(parts))
        numbers, begins = self.of_letter[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)], np.cumsum(letters) - letters
        strange = np.zeros(len(parts), bool)  # a character that is no piece
        strange[np.searchsorted(begins, np.flatnonzero(numbers < 0), side="right") - 1] = True
        few = (letters <= FEW) & ~strange
        sizes, done = np.zeros(len(parts), np.int64), []
        for lo in range(0, FEW, 4):
            rows = np.flatnonzero(few & (letters > lo) & (letters <= lo + 4))
            for k in range(0, len(rows), 20_000):
                done += self._merge_table(rows[k : k + 20_000], numbers, begins, letters)
        for i in np.flatnonzero(~few).tolist():
            done.append((np.array([i]), np.array([self._spelt(self._merged_many(list(parts[i])))], np.int32)))
        for rows, ids in done:
            sizes[rows] = (ids >= 0).sum(axis=1)
        ends, flat = np.cumsum(sizes), np.zeros(sizes.sum(), np.int32)
        for rows, ids in done:
            has = ids >= 0
            flat[((ends - sizes)[rows][:, None] + np.arange(ids.shape[1]))[has]] = ids[has]
        return flat, sizes

    def _merge_table(self, rows: np.ndarray, numbers: np.ndarray, begins: np.ndarray, letters: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and their ids, with -1 after the last; a row leaves the table when none of its pairs is a piece."""
        wide = int(letters[rows].max())
        column = np.arange(wide)
        symbols = np.where(column < letters[rows][:, None], numbers[np.minimum(begins[rows][:, None] + column, len(numbers) - 1)], -1)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        agenda, joint = self._look(symbols[:, :-1], symbols[:, 1:])
        while agenda.size:
            every, at = np.arange(len(rows)), agenda.argmin(axis=1)  # of equal ones the leftmost
            ends = agenda[every, at] >= NEVER
            if ends.any():
                done.append((rows[ends], symbols[ends]))
                rows, symbols, agenda, joint, at = rows[~ends], symbols[~ends], agenda[~ends], joint[~ends], at[~ends]
                every = np.arange(len(rows))
            symbols[every, at] = joint[every, at]
            stay = np.ones(symbols.shape, bool)
            stay[every, at + 1] = False
            m, n = len(rows), symbols.shape[1] - 1
            symbols, agenda, joint = symbols[stay].reshape(m, n), agenda[stay[:, 1:]].reshape(m, n - 1), joint[stay[:, 1:]].reshape(m, n - 1)
            for k in (at - 1, at):
                ok = np.flatnonzero((k >= 0) & (k < n - 1))
                agenda[ok, k[ok]], joint[ok, k[ok]] = self._look(symbols[ok, k[ok]], symbols[ok, k[ok] + 1])
        return [*done, (rows, symbols)]

    def _spelt(self, symbols: list[str]) -> tuple[int, ...]:
        return tuple(chain.from_iterable([self.ids[s]] if s in self.ids else [self.of_byte[b] for b in s.encode()] for s in symbols))

    def _merged_many(self, symbols: list[str]) -> list[str]:
        """With the agenda as a heap, so that a part of n symbols takes n log n steps."""
        n, cost_of = len(symbols), self.cost.get
        after, before, agenda = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for i, joint in enumerate(map(str.__add__, symbols, symbols[1:])):
            if (cost := cost_of(joint)) is not None:
                agenda.append((cost, i, joint))
        heapq.heapify(agenda)
        while agenda:
            _, left, joint = heapq.heappop(agenda)
            right = after[left]
            if symbols[left] is None or right >= n or symbols[left] + symbols[right] != joint:
                continue  # one of the two has been joined with another since
            symbols[left], symbols[right] = joint, None
            after[left] = right = after[right]
            if right < n:
                before[right] = left
                if (cost := cost_of(new := joint + symbols[right])) is not None:
                    heapq.heappush(agenda, (cost, left, new))
            if left and (cost := cost_of(new := symbols[before[left]] + joint)) is not None:
                heapq.heappush(agenda, (cost, before[left], new))
        return [s for s in symbols if s is not None]

    def parts_of(self, chunks: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Parts of the chunks, between which no pair is ever joined, one after another, and the first part of each chunk."""
        joined = "".join(chunks)
        letters = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        before, after = letters[:-1], letters[1:]
        begins = np.ones(len(letters), bool)
        ascii_ = (before | after) < 128
        begins[1:][ascii_] = ~self.meet_ascii[before[ascii_] << 7 | after[ascii_]]
        other = np.flatnonzero(~ascii_)
        key = before[other].astype(np.int64) << 21 | after[other]
        begins[other + 1] = self.meet[np.minimum(np.searchsorted(self.meet, key), len(self.meet) - 1)] != key if len(self.meet) else True
        first = np.cumsum(sizes) - sizes
        begins[first] = True
        edges = np.flatnonzero(begins)
        bytes_ = 1 + (letters >= 0x80) + (letters >= 0x800).astype(np.int64) + (letters >= 0x10000)
        offsets = np.append(np.cumsum(bytes_) - bytes_, bytes_.sum())[np.append(edges, len(letters))].astype(np.int32)
        return pa.StringArray.from_buffers(len(edges), pa.py_buffer(offsets), pa.py_buffer(joined.encode())), np.searchsorted(edges, first)

    def ids_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, none of them empty, one after another, and how many each has; each distinct part is merged once."""
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        parts, first = self.parts_of(chunks)
        parts = parts.dictionary_encode()
        used = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = self.parts.new(used)
        if new:
            self.parts.add(new, *self.merge_all(new))
        flat, sizes = self.parts.of(used, parts.indices.to_numpy())
        return flat, np.add.reduceat(sizes, first)

    def learn(self, words: list[str], check: bool) -> None:
        """Ids of chunks that are a blank and a word, for distinct words that are new; with ``check`` the library has to give the same."""
        new = self.known.new(words)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            flat, sizes = self.ids_of([BLANK + w for w in part])
            if check:
                theirs = self.library.encode(part, num_threads=1)
                if not (np.array_equal(sizes, np.fromiter(map(len, theirs), np.int64, len(theirs))) and np.array_equal(flat, np.fromiter(chain.from_iterable(theirs), np.int32))):
                    own = np.split(flat, np.cumsum(sizes)[:-1])
                    word = next(w for w, a, b in zip(part, own, theirs, strict=True) if a.tolist() != b)
                    raise ValueError(f"the ids of {word!r} differ from the library's")
            self.known.add(part, flat, sizes)

    def encode_all(self, texts: pa.Array, check: bool) -> list[np.ndarray]:
        """Ids of each text. Words between single blanks are found over all texts at once, and distinct ones encoded once."""
        odd = pc.match_substring_regex(texts, f"^ | $|  |{BLANK}|^$") if self.by_word else pa.array([True] * len(texts))
        rows = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        if len(rows):
            lists = pc.split_pattern(texts.take(pa.array(rows)), " ")
            flat = lists.flatten().dictionary_encode()
            words = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
            self.learn(words, check)
            ids, sizes = self.known.of(words, flat.indices.to_numpy())
            ends = np.concatenate([[0], np.cumsum(sizes)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            for row, a, b in zip(rows.tolist(), ends, ends[1:], strict=False):
                out[row] = ids[a:b]
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        rest = texts.take(pa.array(rows)).to_pylist()
        for row, text, ids in zip(rows.tolist(), rest, self.encode_together(rest), strict=True):
            out[row] = ids
            if check and self.library.encode(text) != ids.tolist():
                raise ValueError(f"the ids of {text[:100]!r} differ from the library's")
        return out

    def _chunks(self, written: str) -> Iterator[list[str]]:
        """Chunks of a text, those of about STRETCH characters at a time."""
        start = 0
        while start < len(written):
            found = self.cut and self.cut.search(written, start + STRETCH)
            end = found.start() + 1 if found else len(written)
            yield self.chunk.findall(written[start:end])
            start = end

    def encode(self, text: str) -> np.ndarray:
        return self.encode_together([text])[0]

    def encode_together(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, whatever its blanks: distinct chunks of about STRETCH characters of texts are looked up at once."""
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int32)] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0
        for row, text in enumerate(texts):
            for chunks in self._chunks(self.written(text)):
                held.append((row, chunks))
                size += sum(map(len, chunks))
                if size >= STRETCH:
                    self._settle(held, out)
                    held, size = [], 0
        self._settle(held, out)
        return [np.concatenate(found) for found in out]

    def _settle(self, held: list[tuple[int, list[str]]], out: list[list[np.ndarray]]) -> None:
        """Append the ids of each row's chunks to what the row has."""
        at: dict[str, int] = {}
        codes = np.array([at.setdefault(c, len(at)) for _, chunks in held for c in chunks], np.int64)
        flat, sizes = self.ids_of(list(at))
        ids = ragged(flat, np.cumsum(sizes) - sizes, sizes, codes)
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])[np.cumsum([0, *(len(chunks) for _, chunks in held)])]
        for (row, _), a, b in zip(held, ends, ends[1:], strict=False):
            out[row].append(ids[a:b])

    def decode(self, ids: list[int]) -> str:
        """The text of ids: blanks for their mark, bytes put together, and without the blank that encoding put in front."""
        if self.silent.isdisjoint(ids):
            runs = [ids]
        else:  # bytes on both sides of a silent piece don't form a character
            runs = [list(run) for silent, run in groupby(ids, self.silent.__contains__) if not silent]
        said = "".join(b"".join(map(self.surface.__getitem__, run)).decode("utf-8", "a mark for each byte") for run in runs)
        return said[1:] if self.dummy and runs and runs[0] and runs[0][0] in self.begins else said


def encode_pieces(docs: DataFrame, model: str, check: bool = True, whole: bool = False, text: str = "text") -> DataFrame:
    """Ids of every whole text by a SentencePiece model file of the merge type, and the text that they decode to.

    Returns for each row of ``docs``: doc_id, n_tokens, tokens (array of ids, without begin or end) and
    decoded. A null text counts as empty and has no ids. Rows that share a doc_id, or have none, are
    texts of their own; other columns are not read; an empty table gives no rows. Texts may be of any
    length: a task holds the ids of one batch, and cuts a long text chunk by chunk.

    ``check`` holds all of it against the library, batch by batch, and raises an error for the first
    difference: each distinct word, when its ids are worked out, is encoded by the library too, as is
    each whole text whose blanks don't just part words, and the ids of every whole text are decoded by
    it. With ``whole`` it encodes every whole text as well, which takes as long as all the rest; what words
    of their own show is then seen again, as the vocabulary has no piece across a blank.
    """

    def make() -> callable:
        codec = PieceCodec(model)

        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = pc.fill_null(batch.column(1), "")
            ids, decoded = codec.encode_all(texts, check), []
            for first, part in together(texts):
                own = [i.tolist() for i in ids[first : first + len(part)]]
                back = list(map(codec.decode, own))
                if check:
                    _compare(codec, batch.column(0)[first : first + len(part)].to_pylist(), part.to_pylist() if whole else None, own, back)
                decoded += back
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), lists, pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "tokens", "decoded"])

        return of

    return arrow_map(docs.select("doc_id", text), make, "doc_id long, n_tokens long, tokens array<int>, decoded string")


def _compare(codec: PieceCodec, names: list, texts: list[str] | None, ids: list[list[int]], decoded: list[str]) -> None:
    theirs = ids if texts is None else codec.library.encode(texts, num_threads=1)
    said = codec.library.decode(theirs, num_threads=1)
    for name, a, b, x, y in zip(names, ids, theirs, decoded, said, strict=True):
        if a != b or x != y:
            raise ValueError(f"the ids or the text of document {name} differ from the library's")
