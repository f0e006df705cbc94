"""Words of whole batches of texts, found over their UTF-8 bytes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from serieslab.llm.common import splitmix

#: Which bytes belong to a word. Bytes from 0x80 on only occur in code points from U+0080 on.
NOT_BLANK = np.array([b not in b"\x20\x09\x0a\x0b\x0c\x0d" for b in range(256)])
LETTERS_DIGITS = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Texts are taken together up to about this many bytes, so that the arrays stay in the cache.
TOGETHER = 1 << 20


class Words:
    """The words of some texts: byte spans in ``data`` and, for each text, where its words begin."""

    def __init__(self, texts: pa.Array, kind: np.ndarray) -> None:
        """texts: strings whose A-Z are lower-cased, without nulls."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        whole = texts.buffers()[2]
        self.data = (np.frombuffer(whole, np.uint8) if whole else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = kind[self.data]
        change = inside[1:] != inside[:-1]
        cut = offsets[1:-1]
        cut = cut[inside[cut] & inside[cut + 1]]  # words that touch across two texts
        edges = np.flatnonzero(change)
        if len(cut):
            edges = np.sort(np.concatenate([edges, np.repeat(np.unique(cut), 2)]))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, from prefix sums of a polynomial modulo 2**64."""
        power = np.cumprod(np.full(len(self.data), _BASE)) if len(self.data) else np.zeros(0, np.uint64)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
        inverse = np.cumprod(np.full(len(self.data), _INVERSE)) if len(self.data) else power
        return splitmix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def text(self, start: int, end: int) -> str:
        """Words start to end, joined by spaces."""
        return " ".join(self.data[self.starts[i] : self.ends[i]].tobytes().decode() for i in range(start, end))


def lowered(column: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(column, ""))


def together(texts: pa.Array, most: int = TOGETHER) -> Iterator[tuple[int, pa.Array]]:
    """Slices of the array of about ``most`` bytes (a longer text comes alone), with their first index."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield start, texts.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, texts.slice(start)


def count_words(texts: pa.Array) -> np.ndarray:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in each text."""
    return np.concatenate([np.zeros(0, np.int64), *(Words(part, NOT_BLANK).counts for _, part in together(texts))])


def pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Blank-separated pieces: (number of the distinct piece of each, distinct pieces, offsets of the texts).

    White space here is [\\x20\\x09-\\x0D]; empty pieces, which blanks at an end leave, are not counted.
    """
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten().dictionary_encode()
    codes, offsets = flat.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    empty = pc.index(flat.dictionary, "").as_py()
    if empty >= 0:
        full = codes != empty
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        codes = codes[full]
    return codes, flat.dictionary, offsets
