"""Encode texts piecewise: cut them where no token reaches across, and encode each different segment once."""

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from pagemill.llm.bytewords import hash_segments


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of runs that begin at ``starts``, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - ends + counts, counts) + np.arange(total)


class SegmentCache:
    """The ids of the segments that a worker has seen, known by two 64-bit hashes of their bytes.

    Workers outlive their tasks, so it is bounded in bytes: beyond ``most_bytes`` it keeps
    those that were asked for most often, half of them at most.
    """

    #: Bytes of a segment besides its ids: two hashes, number, uses and bound.
    EACH = 40

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most_bytes: int = 32 << 20):
        self.encode, self.most_bytes = encode, most_bytes
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted first hashes
        self.numbers = np.zeros(0, np.int64)  # the segment of each key
        self.n = 0
        self.checks = np.zeros(1 << 16, np.uint64)  # second hashes by segment
        self.used = np.zeros(1 << 16, np.int64)  # how often a chunk has asked for each
        self.bounds = np.zeros(1 << 16, np.int64)  # where the ids of each begin
        self.ids = np.zeros(1 << 18, np.int32)

    def _store(self, keys: np.ndarray, checks: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Append segments; returns their numbers."""
        n, m = self.n, len(keys)
        begin = int(self.bounds[n])
        while len(self.bounds) <= n + m:
            self.bounds, self.used, self.checks = (np.concatenate([x, np.zeros_like(x)]) for x in (self.bounds, self.used, self.checks))
        while len(self.ids) < begin + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.bounds[n + 1 : n + m + 1] = begin + np.cumsum(sizes)
        self.ids[begin : begin + len(ids)] = ids
        self.checks[n : n + m] = checks
        self.used[n : n + m] = 0
        self.n = n + m
        numbers = np.arange(n, n + m)
        by = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[by])
        self.keys, self.numbers = np.insert(self.keys, at, keys[by]), np.insert(self.numbers, at, numbers[by])
        return numbers

    def _forget(self) -> None:
        half, times = max(1, self.n // 2), self.used[self.numbers]
        least = max(2, int(np.partition(times, -half)[-half]) + 1) if len(times) > half else 2
        keys, kept = self.keys[times >= least], self.numbers[times >= least]
        begins, sizes = self.bounds[kept], self.bounds[kept + 1] - self.bounds[kept]
        ids, checks, used = self.ids[ragged(begins, sizes)], self.checks[kept], self.used[kept] // 2
        self.clear()
        numbers = self._store(keys, checks, sizes, ids)
        self.used[numbers] = used

    def _find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The number of each segment, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        numbers = self.numbers[at]
        return np.where((self.keys[at] == keys) & (self.checks[numbers] == checks), numbers, -1)

    def lookup(self, segments: pa.StringArray) -> np.ndarray:
        """The number of each of these different segments."""
        _, offsets, body = segments.buffers()
        offsets = np.frombuffer(offsets, np.int32, len(segments) + 1, segments.offset * 4).astype(np.int64)
        data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        keys, checks = (hash_segments(data, offsets[:-1], offsets[1:], other) for other in (False, True))
        numbers = self._find(keys, checks)
        new = np.flatnonzero(numbers < 0)
        if len(new) and self.n and (self.n + len(new)) * self.EACH + 4 * int(self.bounds[self.n]) > self.most_bytes:
            self._forget()
            numbers = self._find(keys, checks)
            new = np.flatnonzero(numbers < 0)
        if len(new):
            found = self.encode(segments.take(pa.array(new)).to_pylist())
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((x for part in found for x in part), np.int32, int(sizes.sum()))
            numbers[new] = self._store(keys[new], checks[new], sizes, ids)
        self.used[numbers] += 1
        return numbers

    def encode_all(self, data: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds by text and the ids of all texts, whose segments begin at the bytes ``starts``."""
        bounds = np.append(starts, len(data)).astype(np.int32)
        body = pa.py_buffer(np.ascontiguousarray(data))
        segments = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), body).dictionary_encode()
        which = self.lookup(segments.dictionary)[segments.indices.to_numpy()]
        begins = self.bounds[which]
        counts = self.bounds[which + 1] - begins
        ids = self.ids[ragged(begins, counts)]
        return np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, offsets)], ids
