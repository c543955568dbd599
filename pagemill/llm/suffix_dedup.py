"""Repeated passages, found by a sparse suffix array and cut but for their first place.

A passage is repeated if ``min_words`` consecutive words or more occur in two places,
in one document or in several.  Of all suffixes only those at minimisers are kept:
the least hash of the word groups at the head of a window of ``min_words`` words, so
equal windows keep equal suffixes.  Suffixes are sorted over the cluster by their
first words, which every window of the suffix contains, and then by the whole stretch
of words that the suffix's windows cover; neighbours are compared.  Equal stretches
are repeats.  Where suffixes agree in their first words but not in the whole stretch,
the ends of a passage, the match is extended to the left and right window by window.

The sort has the place as its last key, so a passage that is everywhere is spread over
tasks; a run that a task boundary cuts is settled by the extension.  Words are compared
by 64-bit hashes of their bytes (case counts).

Defined results: the first place is the one with the least (doc_id, key, position), where
``keyed`` gives each document its key: the hash of its text, or for a row without doc_id
a number of its own.  NULL doc_ids come last.  NULL, empty and short texts have no
passages.  Rows that repeat a document (same doc_id and text) are one document and cut
alike; different texts under one doc_id, and rows without doc_id, are documents by themselves.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import bytewords as bw
from pagemill.llm.common import WHITE, Scratch, batches_of

#: What a sorted suffix is: the first or a later place of a repeated stretch, one to be extended,
#: or the first place of a stretch that is to be extended too.
FIRST, LATER, EXTEND, FIRST_EXTEND = range(4)
BLANK = WHITE.decode()


@dataclass(frozen=True)
class Passages:
    """``min_words`` in a row make a passage; a minimiser is taken from ``spread`` word groups."""

    min_words: int = 50
    spread: int = 25
    group: int = 5

    @property
    def head(self) -> int:
        """Words of a suffix that all its windows contain."""
        return self.min_words - self.spread + 1


def anchors(chunk: bw.Chunk, rule: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, first words of all whole windows, and the word at which the suffix of each begins."""
    words = chunk.word_hashes()
    ends = np.repeat(chunk.word_offsets[1:], np.diff(chunk.word_offsets))
    starts = np.flatnonzero(np.arange(len(words)) + rule.min_words <= ends)
    if not len(starts):
        return words, starts, starts
    groups = bw.window_hashes(words, rule.group)
    least = np.lib.stride_tricks.sliding_window_view(groups, rule.spread).argmin(1)
    return words, starts, starts + least[starts]


#: What names a document; the key's column has a name that inputs hardly have.
DOC = ["doc_id", "_key"]


def keyed(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """``documents`` with ``_key``, which tells different documents of one doc_id apart, and those without one.

    Only the rows without doc_id are written: their keys must not change when a task is repeated.
    """
    named = documents.where("doc_id is not null").withColumn("_key", F.xxhash64("text"))
    nameless = documents.where("doc_id is null").withColumn("_key", F.monotonically_increasing_id())
    return named.unionByName(scratch.save(nameless, "nameless"))


_SUFFIXES = pa.schema(
    [("head", pa.int64()), ("stretch", pa.int64()), ("doc_id", pa.int64()), ("_key", pa.int64())]
    + [("pos", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())]
)


def _take(batch: pa.RecordBatch, rows: np.ndarray) -> dict[str, pa.Array]:
    return {c: batch[c].take(pa.array(rows)) for c in DOC}


def suffixes(documents: DataFrame, rule: Passages) -> DataFrame:
    """The kept suffixes: hashes of head and stretch, and the places of both in words of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in bw.chunks(batch["text"]):
                words, starts, at = anchors(chunk, rule)
                if not len(at):
                    continue
                # Windows with the same suffix follow each other.
                turn = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                pos, lo = at[turn], starts[turn]
                hi = starts[np.append(turn[1:], len(at)) - 1] + rule.min_words
                text = np.searchsorted(chunk.word_offsets, pos, "right") - 1
                base = chunk.word_offsets[text]
                yield from batches_of(
                    {
                        "head": bw.span_hashes(words, pos, pos + rule.head).view(np.int64),
                        "stretch": bw.mix(bw.span_hashes(words, lo, hi) + (pos - lo).astype(np.uint64)).view(np.int64),
                        "pos": (pos - base).astype(np.int32),
                        "lo": (lo - base).astype(np.int32),
                        "hi": (hi - base).astype(np.int32),
                    }
                    | _take(batch, chunk.first + text),
                    _SUFFIXES,
                )

    rows = documents.select(F.col("doc_id").cast("long"), "_key", "text")
    return rows.mapInArrow(run, "head long, stretch long, doc_id long, _key long, pos int, lo int, hi int")


_COMPARED = pa.schema([*((c, pa.int64()) for c in DOC), *((c, pa.int32()) for c in ("pos", "lo", "hi", "state"))])


def compare_neighbours(found: DataFrame) -> DataFrame:
    """Sort the suffixes and keep those whose head a neighbour has, with a state.

    A task holds one batch at a time.  Of the heads at its ends other batches or tasks may
    hold more, so these are left to the extension.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            n = len(rows)
            if not n:
                continue
            head, stretch, key, pos = (rows[c].to_numpy() for c in ("head", "stretch", "_key", "pos"))
            known = rows["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            doc = rows["doc_id"].fill_null(0).to_numpy()
            place = np.stack([doc, known, key, pos], 1)
            new_head = np.append(True, head[1:] != head[:-1])
            new_stretch = new_head | np.append(True, stretch[1:] != stretch[:-1])
            new_place = new_stretch | np.append(True, (place[1:] != place[:-1]).any(1))
            of_head, of_stretch = np.cumsum(new_head) - 1, np.cumsum(new_stretch) - 1
            places = np.bincount(of_head[new_place], minlength=of_head[-1] + 1)
            kinds = np.bincount(of_head[new_stretch], minlength=of_head[-1] + 1)
            opening = np.flatnonzero(new_stretch)[of_stretch]  # first row of the same stretch
            first = (place == place[opening]).all(1)
            cut = (of_head == 0) | (of_head == of_head[n - 1])
            again = np.bincount(of_stretch[new_place], minlength=of_stretch[-1] + 1)[of_stretch] > 1
            ends = (kinds[of_head] > 1) | cut
            state = np.where(~first, LATER, np.where(~ends, FIRST, np.where(again, FIRST_EXTEND, EXTEND))).astype(np.int32)
            keep = np.flatnonzero(((places[of_head] > 1) | cut) & new_place)
            taken = rows.take(pa.array(keep))
            yield from batches_of({c: taken[c] for c in (*DOC, "pos", "lo", "hi")} | {"state": state[keep]}, _COMPARED)

    order = ["head", "stretch", F.col("doc_id").asc_nulls_last(), "_key", "pos"]
    return (
        found.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(run, "doc_id long, _key long, pos int, lo int, hi int, state int")
    )


def extend(documents: DataFrame, undecided: DataFrame, rule: Passages) -> DataFrame:
    """(key, doc_id, _key, lo): the windows of undecided suffixes."""
    out = pa.schema([("key", pa.int64()), *((c, pa.int64()) for c in DOC), ("lo", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch["places"]
            for chunk in bw.chunks(batch["text"]):
                words, starts, at = anchors(chunk, rule)
                asked = np.zeros(len(words) + 1, bool)
                for i in range(len(chunk)):
                    a, b = chunk.span(i)
                    places = a + wanted[chunk.first + i].values.to_numpy()
                    asked[places[places < b]] = True
                starts = starts[asked[at]]
                text = np.searchsorted(chunk.word_offsets, starts, "right") - 1
                yield from batches_of(
                    {
                        "key": bw.span_hashes(words, starts, starts + rule.min_words).view(np.int64),
                        "lo": (starts - chunk.word_offsets[text]).astype(np.int32),
                    }
                    | _take(batch, chunk.first + text),
                    out,
                )

    places = undecided.groupBy(*DOC).agg(F.collect_set("pos").alias("places"))
    rows = same_doc(documents.select(F.col("doc_id").cast("long"), "_key", "text"), places, "inner")
    return rows.select(*DOC, "text", "places").mapInArrow(run, "key long, doc_id long, _key long, lo int")


def same_doc(documents: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """``documents`` joined with ``facts`` of documents; missing ids are equal."""
    facts = facts.withColumnsRenamed({c: f"_of_{c}" for c in DOC})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_of_doc_id")) & (F.col("_key") == F.col("_of__key"))
    return documents.join(facts, same, how).drop(*(f"_of_{c}" for c in DOC))


def repeated_windows(windows: DataFrame, rule: Passages, scratch: Scratch) -> DataFrame:
    """(doc_id, _key, lo, hi, later) of the windows that occur in two places or more."""
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), *DOC, "lo")
    groups = windows.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    groups = scratch.save(groups, "window-groups")  # a table, so that its join splits at a passage that is everywhere
    return windows.join(groups, "key").select(
        *DOC, "lo", (F.col("lo") + rule.min_words).alias("hi"), (~place.eqNullSafe(F.col("first"))).alias("later")
    )


def spans(documents: DataFrame, rule: Passages | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, _key, repeated, later) of the ``keyed`` documents with repeats: merged [start, end) spans of words.

    ``repeated`` has every place of a repeated passage, ``later`` all but the first.
    """
    rule, scratch = rule or Passages(), scratch or Scratch(documents.sparkSession)
    found = scratch.save(suffixes(documents, rule), "suffixes")
    compared = scratch.save(compare_neighbours(found), "compared")
    scratch.drop("suffixes")
    windows = scratch.save(extend(documents, compared.where(F.col("state").isin(EXTEND, FIRST_EXTEND)), rule), "windows")
    ends = repeated_windows(windows, rule, scratch)
    whole = compared.where(F.col("state") != EXTEND).select(*DOC, "lo", "hi", (F.col("state") == LATER).alias("later"))
    by_doc = whole.union(ends).groupBy(*DOC).agg(F.collect_list(F.struct("lo", "hi", "later")).alias("parts"))
    pairs = "array<struct<start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeated, later = [], []
            for parts in batch["parts"]:
                lo, hi, flag = (parts.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                repeated.append(_union(lo, hi))
                later.append(_union(lo[flag], hi[flag]))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in DOC), pa.array(repeated, kind), pa.array(later, kind)], names=[*DOC, "repeated", "later"]
            )

    return by_doc.mapInArrow(run, f"doc_id long, _key long, repeated {pairs}, later {pairs}")


def _union(lo: np.ndarray, hi: np.ndarray) -> list[dict[str, int]]:
    """Merge intervals that touch."""
    if not len(lo):
        return []
    by = np.argsort(lo, kind="stable")
    lo, hi = lo[by], np.maximum.accumulate(hi[by])
    opens = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
    closes = np.append(opens[1:], len(lo)) - 1
    return [{"start": int(a), "end": int(b)} for a, b in zip(lo[opens], hi[closes], strict=True)]


def cut(documents: DataFrame, found: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """``keyed`` documents without the words of ``found.later``, and what follows each up to the next word.

    ``drop_emptied`` drops the rows that keep no word of those they had.  The key is left out.
    """
    columns = [c for c in documents.columns if c != "_key"]
    later = found.where(F.size("later") > 0).select(*DOC, F.col("later").alias("_cut"))
    rows = same_doc(documents, later, "left").drop("_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = batch["text"], batch["_cut"]
            some = np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                kept = dict(zip(some.tolist(), _without(texts.take(pa.array(some)), cuts.take(pa.array(some))), strict=True))
                texts = pa.array([kept.get(i, x) for i, x in enumerate(texts.to_pylist())], texts.type)
            out = pa.RecordBatch.from_arrays([texts if c == "text" else batch[c] for c in columns], names=columns)
            if len(some) and drop_emptied:
                stay = np.array([bool(kept.get(i, "x").strip(BLANK)) for i in range(len(out))])
                out = out.filter(pa.array(stay))
            yield out

    return rows.mapInArrow(run, documents.drop("_key").schema)


def _without(texts: pa.Array, cuts: pa.Array) -> list[str]:
    out = []
    for chunk in bw.chunks(texts):
        for i in range(len(chunk)):
            a, b = chunk.span(i)
            first, last = int(chunk.offsets[i]), int(chunk.offsets[i + 1])
            kept, at = [], first
            for span in cuts[chunk.first + i].as_py():
                begin, stop = a + span["start"], min(a + span["end"], b)
                if begin >= b:
                    continue
                kept.append(chunk.data[at : chunk.starts[begin]].tobytes())
                at = int(chunk.starts[stop]) if stop < b else last
            kept.append(chunk.data[at:last].tobytes())
            out.append(b"".join(kept).decode())
    return out
