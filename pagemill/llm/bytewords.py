"""Words of Arrow text columns as arrays of positions and 64-bit hashes.

The loops run over bytes and words inside numpy, never over rows, so a batch of
texts costs a few passes over its bytes.  Hashes are functions of the bytes of a
word alone: equal words have equal hashes in every task and at every size.  Two
different words share a 64-bit hash with a chance of about 2**-64.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pagemill.llm.common import WHITE

CHUNK_BYTES = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_OTHER_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACES = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _table(name: str, base: np.uint64, n: int) -> np.ndarray:
    """Powers of ``base``; those for a chunk are kept, those for a longer text are not."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size == CHUNK_BYTES + 1:
            _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: bool = False) -> np.ndarray:
    """A hash of the bytes of each segment; ``other`` gives a second one, independent of the first.

    Segments are in order.  They are taken in blocks of about CHUNK_BYTES, so a long
    text needs no more memory than a short one, but for a segment that is longer.
    """
    values, out, k = _OTHER_BYTE if other else _BYTE, np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        first = int(starts[k])
        last = max(k + 1, int(np.searchsorted(ends, first + CHUNK_BYTES, "right")))
        block = data[first : int(ends[last - 1])]
        n = len(block)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values[block] * _table("up", _BASE, n), out=prefix[1:])
        begins = starts[k:last] - first
        out[k:last] = (prefix[ends[k:last] - first] - prefix[begins]) * _table("down", _BASE_INVERSE, n + 1)[begins]
        k = last
    return mix(out)


@dataclass
class Chunk:
    """Consecutive texts: their bytes, where they begin, and their words."""

    first: int  # index of the first text in the batch
    data: np.ndarray  # uint8
    offsets: np.ndarray  # n + 1 positions in data
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    word_offsets: np.ndarray  # n + 1 positions in starts

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def span(self, i: int) -> tuple[int, int]:
        return int(self.word_offsets[i]), int(self.word_offsets[i + 1])

    def word_texts(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self)), np.diff(self.word_offsets))

    def segment_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each segment."""
        return hash_segments(self.data, starts, ends)

    def word_hashes(self) -> np.ndarray:
        return self.segment_hashes(self.starts, self.ends)

    def texts_of_byte(self, position: int) -> int:
        return int(np.searchsorted(self.offsets, position, "right")) - 1


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` words; fewer words give an empty array."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if width <= 8:
        total = np.zeros(n, np.uint64)
        for j in range(width):
            total += words[j : j + n] * _PLACES[j]
        return mix(total)
    at = np.arange(n)
    return span_hashes(words, at, at + width)


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of words."""
    n = len(words)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _table("up", _BASE, n), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * _table("down", _BASE_INVERSE, n + 1)[starts])


def chunks(
    texts: pa.Array, lower: bool = False, max_bytes: int = CHUNK_BYTES, breaks: bytes = WHITE, max_texts: int | None = None
) -> Iterator[Chunk]:
    """Cut a text column between texts into chunks of about ``max_bytes``; ``breaks`` are no part of words.

    A NULL text is an empty one.  A text longer than a chunk is one by itself.  ``max_texts``
    bounds the texts of a chunk too, for what takes memory by text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, body = texts.buffers()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(offsets, wide, n + 1, texts.offset * wide().itemsize).astype(np.int64)
    body = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    is_break = np.zeros(256, bool)
    is_break[list(breaks)] = True
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1)
        last = min(last, n, first + (max_texts or n))
        data = body[offsets[first] : offsets[last]]
        if lower:
            data = LOWER[data]
        at = offsets[first : last + 1] - offsets[first]
        space = is_break[data]
        fresh = np.ones(len(data) + 1, bool)  # a word may begin here
        fresh[1:] = True
        if len(data):
            fresh[1:-1] = space[:-1]
            fresh[at[:-1][at[:-1] < len(data)]] = True
            begins = fresh[:-1] & ~space
            stops = np.ones(len(data), bool)  # a word may end before the next byte
            stops[:-1] = space[1:] | fresh[1:-1]
            stops &= ~space
            starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        else:
            starts = ends = np.zeros(0, np.int64)
        yield Chunk(first, data, at, starts, ends, np.searchsorted(starts, at))
        first = last
