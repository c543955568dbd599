"""Periodic runs of words: stretches that repeat a block at least ``exponent`` times.

A run is a stretch of consecutive words with smallest period q (words q apart are equal),
at least max(``least``, ``exponent`` * q) long, that no neighbouring word extends.  Every
word of a run occurs ``exponent`` times in it or more.  So a word that occurs less often
within its segment, at first the document, is in no run there: such words split the
segment, and the parts are counted and split again until nothing changes.  No run
crosses a split, as all places of the splitting word in the segment are splits.

The segments that survive are scanned by lags.  A run of period q contains, of any
places q apart, one at which 3 q words follow with that period; so a lag q is looked
at every q words only, by two words and then by the hash of the whole stretch, and a
segment of m words takes m log m looks.  What is found is extended to both sides by
comparing words, and found again at a multiple of its period is left out.

The work is within documents, so nothing is shuffled.  Words are known by 64-bit hashes
of their bytes (case counts).

Defined results: a NULL, empty or wordless text has no words and no runs, and collapses
to the empty text.  Every row is answered by itself, whatever its id; other columns are
ignored unless kept.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import bytewords as bw
from pagemill.llm.segments import ragged

#: Places looked at together, and words written together.
LOOKS = 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@dataclass(frozen=True)
class Rule:
    """A run repeats its period ``exponent`` times (4 at least) and has ``least`` words."""

    exponent: int = 4
    least: int = 6

    def __post_init__(self) -> None:
        if self.exponent < 4 or self.least < 1:
            raise ValueError("a run repeats its period four times or more")

    def shortest(self, period: np.ndarray) -> np.ndarray:
        return np.maximum(self.least, self.exponent * period)


def split(words: np.ndarray, bounds: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the segments in which every word occurs often enough, or may.

    ``bounds`` are those of the documents; ``words`` numbers from 0.
    """
    size = max(rule.least, rule.exponent)
    begins, ends = bounds[:-1], bounds[1:]
    done_b, done_e = [], []
    kinds = int(words.max()) + 1 if len(words) else 1
    while True:
        long = ends - begins >= size
        begins, ends = begins[long], ends[long]
        if not len(begins):
            break
        lengths = ends - begins
        place = ragged(begins, lengths)
        segment = np.repeat(np.arange(len(begins)), lengths)
        _, which, times = np.unique(segment * kinds + words[place], return_inverse=True, return_counts=True)
        stays = times[which] >= rule.exponent
        whole = np.bincount(segment[~stays], minlength=len(begins)) == 0
        done_b.append(begins[whole])
        done_e.append(ends[whole])
        left = stays & ~whole[segment]
        place, segment = place[left], segment[left]
        opens = np.ones(len(place), bool)
        opens[1:] = (place[1:] != place[:-1] + 1) | (segment[1:] != segment[:-1])
        at = np.flatnonzero(opens)
        begins = place[at]
        ends = place[np.append(at[1:], len(place)) - 1] + 1 if len(at) else begins
    begins, ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_b, done_e))
    by = np.argsort(begins)
    return begins[by], ends[by]


def _equal_stretch(words: np.ndarray, at: int, lag: int, begin: int, end: int) -> tuple[int, int]:
    """The longest [l, r) around ``at`` within the segment whose words equal those ``lag`` after them."""
    r, step = at, 4 * lag + 64
    while r < end - lag:
        stop = min(r + step, end - lag)
        differ = np.flatnonzero(words[r:stop] != words[r + lag : stop + lag])
        if len(differ):
            r += int(differ[0])
            break
        r, step = stop, 2 * step
    l, step = at, 4 * lag + 64
    while l > begin:
        start = max(l - step, begin)
        differ = np.flatnonzero(words[start:l] != words[start + lag : l + lag])
        if len(differ):
            l = start + int(differ[-1]) + 1
            break
        l, step = start, 2 * step
    return l, r


def _looks(begins: np.ndarray, ends: np.ndarray, low: int, high: int, rule: Rule) -> Iterator[tuple[np.ndarray, ...]]:
    """(place, lag, segment) to look at for the lags from ``low`` to ``high``, some at a time, by lag and place."""
    lengths = ends - begins
    some = np.flatnonzero(lengths >= rule.shortest(np.array(low)))
    most = np.minimum(high, np.maximum(lengths[some] // rule.exponent, 1))
    count = most - low + 1
    segment = np.repeat(some, count)
    lag = low + ragged(np.zeros(len(some), np.int64), count)
    by = np.lexsort((segment, lag))
    segment, lag = segment[by], lag[by]
    each = (lengths[segment] - 3 * lag) // lag + 1
    total, first = np.cumsum(each), 0
    while first < len(each):
        stop = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + LOOKS, "right")))
        part = slice(first, stop)
        of = np.repeat(np.arange(first, stop), each[part])
        step = ragged(np.zeros(stop - first, np.int64), each[part])
        yield begins[segment[of]] + step * lag[of], lag[of], segment[of]
        first = stop


def find_runs(words: np.ndarray, bounds: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs, by start and period; words by number, documents by ``bounds``."""
    begins, ends = split(words, bounds, rule)
    found: list[tuple[int, int, int]] = []
    if len(begins):
        spread = bw.mix(words.astype(np.uint64) + np.uint64(1))
        reach = np.zeros(len(words) + 1, np.int64)  # by place: the furthest end of a run over it
        low, longest = 1, int((ends - begins).max())
        while rule.shortest(np.array(low)) <= longest:
            fresh = []
            for at, lag, segment in _looks(begins, ends, low, 2 * low - 1, rule):
                keep = np.flatnonzero(words[at] == words[at + lag])
                keep = keep[words[at[keep] + lag[keep]] == words[at[keep] + 2 * lag[keep]]]
                keep = keep[reach[at[keep]] < at[keep] + 3 * lag[keep]]
                if not len(keep):
                    continue
                at, lag, segment = at[keep], lag[keep], segment[keep]
                same = bw.span_hashes(spread, at, at + 2 * lag) == bw.span_hashes(spread, at + lag, at + 3 * lag)
                at, lag, segment = at[same], lag[same], segment[same]
                k = 0
                while k < len(at):
                    q = int(lag[k])
                    s = int(segment[k])
                    l, r = _equal_stretch(words, int(at[k]), q, int(begins[s]), int(ends[s]))
                    if r + q - l >= rule.shortest(np.array(q)):
                        fresh.append((l, r + q - l, q))
                    # The next place behind this stretch, or of another lag.
                    behind = int(np.searchsorted(lag, q, "right"))
                    k = max(k + 1, k + int(np.searchsorted(at[k:behind], r, "left")))
            # A lag has no multiple among the lags of one round, so what is reached counts from the next on.
            for start, length, _ in fresh:
                part = reach[start : start + length]
                np.maximum(part, start + length, out=part)
            found += fresh
            low *= 2
    runs = np.array(sorted(set(found), key=lambda x: (x[0], x[2])), np.int64).reshape(-1, 3)
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _joined(chunk: bw.Chunk, kept: np.ndarray) -> pa.StringArray:
    """The words at ``kept`` of each text, with one space between them."""
    starts, ends = chunk.starts[kept], chunk.ends[kept]
    text = np.searchsorted(chunk.word_offsets, kept, "right") - 1
    last = np.append(text[1:] != text[:-1], True) if len(kept) else np.zeros(0, bool)
    sizes = ends - starts + ~last
    stops = np.cumsum(sizes)
    out = np.empty(int(stops[-1]) if len(stops) else 0, np.uint8)
    for a in range(0, len(kept), LOOKS):
        part = slice(a, a + LOOKS)
        out[(stops[a] - sizes[a]) : stops[part][-1]] = chunk.data[ragged(starts[part], sizes[part])]
    out[stops[~last] - 1] = 32
    offsets = np.append(0, stops)[np.searchsorted(text, np.arange(len(chunk) + 1))] if len(kept) else np.zeros(len(chunk) + 1)
    return pa.StringArray.from_buffers(len(chunk), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out))


def runs_of_chunk(chunk: bw.Chunk, rule: Rule) -> tuple[pa.ListArray, pa.StringArray]:
    """The runs of each text, and the text without the words that a run repeats."""
    words = np.unique(chunk.word_hashes(), return_inverse=True)[1].astype(np.int64)
    start, length, period = find_runs(words, chunk.word_offsets.astype(np.int64), rule)
    over = np.zeros(len(words) + 1, np.int64)
    np.add.at(over, start + period, 1)
    np.add.at(over, start + length, -1)
    kept = np.flatnonzero(np.cumsum(over[:-1]) == 0)
    bounds = np.searchsorted(start, chunk.word_offsets)
    text = np.searchsorted(chunk.word_offsets, start, "right") - 1
    body = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - chunk.word_offsets[text], length, period)], fields=list(RUN))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), body), _joined(chunk, kept)


def periodic_runs(documents: DataFrame, rule: Rule | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) with ``n_words``, ``runs`` (by start, then period) and ``collapsed``.

    ``collapsed`` has the words that no run contains after its first period, joined by one
    space.  Columns of these names are replaced.
    """
    rule, new = rule or Rule(), ("n_words", "runs", "collapsed")
    kept = [c for c in (documents.columns if keep is None else keep) if c not in new]
    rows = documents.select(*dict.fromkeys([*kept, "text"]))
    kind = "array<struct<start:long,length:long,period:long>>"
    out = rows.select(*kept, F.lit(0).cast("long").alias("n_words"), F.array().cast(kind).alias("runs"), F.lit("").alias("collapsed")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in bw.chunks(batch["text"]):
                runs, collapsed = runs_of_chunk(chunk, rule)
                part = batch.slice(chunk.first, len(chunk))
                n = pa.array(np.diff(chunk.word_offsets), pa.int64())
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), n, runs, collapsed], names=[*kept, *new])

    return rows.mapInArrow(run, out)


def longest(runs: str = "runs") -> F.Column:
    """The longest run as a struct; of equal ones the first, then that of the least period; NULL without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period"))
