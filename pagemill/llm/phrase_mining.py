"""Phrases that occur often and whose parts seldom go apart, by relational mining.

The occurrences of phrases of one length are a relation (piece, position, phrase), sorted
by piece and position and written as a table.  Every length takes the same steps: keep the
occurrences of frequent phrases (semi-join), join the relation with itself on the same
piece and the next position, which gives the occurrences of phrases one word longer, and
count these by phrase.  A phrase of n + 1 words that is frequent has two frequent phrases
of n words at neighbouring positions, so nothing is lost.

A row of the table holds a document's part of the relation as two sorted arrays.  Numbers
of positions leave a gap between pieces, so (piece, position) is one number and the join
is a comparison of neighbours in the task that reads the row: occurrences are never
shuffled, only counts, which are summed in the task first.  The frequent phrases of one
length go to the tasks as a sorted array if these are at most ``HELD``; beyond that the
semi-join is one of two tables, by phrase, and its rows are put together again.

Words are known by 64-bit hashes and by their text in the end, longer phrases by the
numbers of their parts (by 64-bit hashes where these are too many to be held).

Defined results: a NULL text is empty, a NULL language is ``und``; repeated rows count
each; other columns, and doc_id, are not looked at.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm import bytewords as bw
from pagemill.llm.common import Scratch, batches_of
from pagemill.llm.segments import ragged

#: Frequent phrases of one length that a task gets as an array of 8 bytes each.
HELD = 1 << 21
#: Occurrences that a task extends together, and counted phrases that it sums before it hands them on.
TOGETHER, TALLIED = 1 << 18, 1 << 20
#: Bytes of the relation that a task writes together; one task reads and sums them, so fewer counts are shuffled.
RELATION_BYTES = 128 << 20
#: Rows that one group of a ranking holds.
RANKED = 1 << 17
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b" \t"


@dataclass(frozen=True)
class Mining:
    longest: int = 5
    least: int = 100  # occurrences of a frequent phrase
    top: int = 2000  # phrases returned of each language
    absorbed: int = 100  # a phrase goes if a longer one has so many percent of its occurrences


_KIND = "kind int, lang string, word string, key long, left long, right long, n long, pos array<int>, keys array<long>"
_ROWS = pa.schema(
    [("kind", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("key", pa.int64()), ("left", pa.int64()), ("right", pa.int64())]
    + [("n", pa.int64()), ("pos", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64()))]
)


def _rows(n: int, /, **columns) -> Iterator[pa.RecordBatch]:
    yield from batches_of({f.name: columns.get(f.name, pa.nulls(n, f.type)) for f in _ROWS}, _ROWS)


def _relation(bounds: np.ndarray, pos: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row (kind 0) for each document that has occurrences."""
    sizes = np.diff(bounds)
    offsets = pa.array(np.append(0, np.cumsum(sizes[sizes > 0])).astype(np.int32))
    n = int((sizes > 0).sum())
    arrays = (pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pos.astype(np.int32), keys.view(np.int64)))
    yield from _rows(n, kind=np.zeros(n, np.int32), **dict(zip(("pos", "keys"), arrays, strict=True)))


class Tally:
    """Counts by key of a task, summed over its batches; hands on rows of kind 1."""

    def __init__(self):
        self.parts: list[dict] = []
        self.n = 0

    def add(self, **columns) -> Iterator[pa.RecordBatch]:
        """Different keys, their counts ``n``, and what belongs to each."""
        self.parts.append(columns)
        self.n += len(columns["key"])
        if self.n >= TALLIED:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        parts, self.parts, self.n = self.parts, [], 0
        if not parts:
            return
        _, first, which = np.unique(np.concatenate([p["key"] for p in parts]), return_index=True, return_inverse=True)
        times = np.bincount(which, weights=np.concatenate([p["n"] for p in parts])).astype(np.int64)
        out = {}
        for name in parts[0]:
            whole = [p[name] for p in parts]
            out[name] = pa.concat_arrays(whole).take(pa.array(first)) if isinstance(whole[0], pa.Array) else np.concatenate(whole)[first]
        yield from _rows(len(first), **out | {"kind": np.ones(len(first), np.int32), "n": times})


def _language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def words(documents: DataFrame) -> DataFrame:
    """The relation of single words (kind 0), and the count of each word of a batch (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            langs = batch["lang"].dictionary_encode()
            names = langs.dictionary.to_pylist()
            hashes, of = np.array([_language_hash(x) for x in names], np.uint64), langs.indices.to_numpy()
            for chunk in bw.chunks(batch["text"], lower=True, breaks=BLANKS + PIECE_ENDS):
                if not len(chunk.starts):
                    continue
                text = chunk.word_texts()
                lang = of[chunk.first + text]
                keys = bw.mix(chunk.word_hashes() + bw.mix(hashes)[lang])
                # The piece grows by one at every sign that ends it, and by words by place.
                ends = np.flatnonzero(np.isin(chunk.data, np.frombuffer(PIECE_ENDS, np.uint8)))
                piece = np.searchsorted(ends, chunk.starts)
                fresh = np.append(False, (piece[1:] != piece[:-1]) & (text[1:] == text[:-1]))
                place = np.arange(len(text)) + np.cumsum(fresh)
                bounds = chunk.word_offsets.astype(np.int64)
                pos = place - place[np.minimum(bounds[:-1], len(place) - 1)][text]
                yield from _relation(bounds, pos, keys)
                different, at, times = np.unique(keys, return_index=True, return_counts=True)
                sizes = chunk.ends[at] - chunk.starts[at]
                body = np.ascontiguousarray(chunk.data[ragged(chunk.starts[at], sizes)])
                offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
                texts = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(body))
                named = pa.array(names, pa.string()).take(pa.array(lang[at]))
                yield from tally.add(key=different.view(np.int64), n=times, lang=named, word=texts)
        yield from tally.flush()

    rows = documents.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return rows.mapInArrow(run, _KIND)


def longer(relation: DataFrame, frequent: np.ndarray | None) -> DataFrame:
    """The relation of phrases one word longer (kind 0), and their counts in a task (kind 1).

    ``frequent`` are the sorted keys of the phrases that stay.  A longer phrase is then known
    by the numbers of its two parts among these, 32 bits each, which says what it is without
    further columns.  None, if the relation has no others: it is known by a hash of both keys.
    """
    held = relation.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stays, tally = held.value, Tally()
        for batch in batches:
            bounds = batch["pos"].offsets.to_numpy().astype(np.int64)
            first = 0
            while first < len(batch):
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + TOGETHER, "right")) - 1)
                pos, keys = (batch[c].values[bounds[first] : bounds[last]].to_numpy() for c in ("pos", "keys"))
                row = np.repeat(np.arange(last - first, dtype=np.int32), np.diff(bounds[first : last + 1]))
                if stays is not None:
                    spot = np.minimum(np.searchsorted(stays, keys), len(stays) - 1)
                    kept = np.flatnonzero(stays[spot] == keys)
                    pos, keys, row = pos[kept], spot[kept], row[kept]
                at = np.flatnonzero((pos[1:] == pos[:-1] + 1) & (row[1:] == row[:-1]))
                left, right = keys[at], keys[at + 1]
                if stays is not None:
                    joined = left << 32 | right
                else:
                    joined = bw.mix(bw.mix(left.view(np.uint64)) * np.uint64(3) + right.view(np.uint64)).view(np.int64)
                yield from _relation(np.searchsorted(row[at], np.arange(last - first + 1)), pos[at], joined)
                different, where, times = np.unique(joined, return_index=True, return_counts=True)
                parts = {"left": left[where], "right": right[where]} if stays is None else {}
                yield from tally.add(key=different, n=times, **parts)
                first = last
        yield from tally.flush()

    return relation.select("pos", "keys").mapInArrow(run, _KIND)


def semi_join(relation: DataFrame, frequent: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The occurrences of frequent phrases, by a join of two tables, as rows like before."""
    numbered = scratch.save(relation.select(F.monotonically_increasing_id().alias("row"), "pos", "keys"), f"{name}-numbered")
    flat = numbered.select("row", F.explode(F.arrays_zip("pos", "keys")).alias("o")).select("row", "o.pos", F.col("o.keys").alias("key"))
    kept = flat.join(frequent.select("key"), "key").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("o"))
    return scratch.save(kept.select(F.col("o.pos").alias("pos"), F.col("o.key").alias("keys")), f"{name}-kept")


def frequent_phrases(documents: DataFrame, mining: Mining, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all frequent phrases, single words too; and (lang, n) of all words."""
    seen = scratch.save(words(documents), "words", RELATION_BYTES)
    counted = seen.where("kind = 1")
    totals = scratch.save(counted.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    found = counted.groupBy("lang", "word", "key").agg(F.sum("n").alias("f")).where(F.col("f") >= mining.least)
    found = scratch.save(found.select("key", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f"), "frequent-1")
    phrases = found.withColumn("size", F.lit(1))
    for size in range(2, mining.longest + 1):
        many = found.count()
        if not many:
            break
        relation = seen.where("kind = 0")
        if many <= HELD:
            keys = np.sort(found.select("key").toArrow()["key"].to_numpy())
        else:
            relation, keys = semi_join(relation, found, scratch, f"semi-{size}"), None
        grown = scratch.save(longer(relation, keys), f"words-{size}", RELATION_BYTES)
        scratch.drop("words" if size == 2 else f"words-{size - 1}", f"semi-{size}-numbered", f"semi-{size}-kept")
        counted, f = grown.where("kind = 1"), F.sum("n").alias("f")
        if keys is None:
            counts, parts = counted.groupBy("key").agg(f, F.min("left").alias("left"), F.min("right").alias("right")), found
            parts = parts.withColumn("part", F.col("key"))
        else:
            left, right = F.shiftright("key", 32).alias("left"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("right")
            counts = counted.groupBy("key").agg(f).select("key", "f", left, right)
            numbers = found.sparkSession.createDataFrame(pa.table({"key": keys, "part": np.arange(len(keys))}))  # at most HELD
            parts = found.join(scratch.save(numbers, f"numbers-{size}"), "key")
        counts = scratch.save(counts.where(F.col("f") >= mining.least), f"counts-{size}")
        head = parts.select(F.col("part").alias("left"), "lang", "phrase")
        tail = parts.select(F.col("part").alias("right"), "last")
        named = counts.join(head, "left").join(tail, "right")
        named = named.select("key", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f")
        seen, found = grown, scratch.save(named, f"frequent-{size}")
        phrases = phrases.unionByName(found.withColumn("size", F.lit(size)))
    return phrases.select("lang", "phrase", "size", "f"), totals


def weakest_cuts(phrases: DataFrame, totals: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more, by the cut of the least score."""
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    cuts = phrases.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("w"), cut.alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut",
        F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.col("size") - F.col("cut")), " ").alias("tail"),
    )
    head = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tail = phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = cuts.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).join(totals, "lang")
    wide = lambda c: f"cast({c} as decimal(38,0))"
    score = F.expr(f"({wide('1000')} * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    least = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("least")
    best = scored.groupBy("lang", "phrase", "a", "n").agg(least)
    return best.select("lang", "phrase", "a", "least.l", "least.r", "n", "least.score")


def without_absorbed(candidates: DataFrame, phrases: DataFrame, mining: Mining) -> DataFrame:
    """The candidates that no longer frequent phrase holds nearly always.

    One word more is enough to look at: what is in between occurs at least as often as the longer one.
    """
    longer_ones = phrases.where("size > 2").withColumn("w", F.split("phrase", " "))
    parts = F.array(F.slice("w", 1, F.col("size") - 1), F.slice("w", 2, F.col("size") - 1))
    inside = longer_ones.select("lang", F.explode(F.transform(parts, lambda w: F.array_join(w, " "))).alias("phrase"), "f")
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = candidates.join(inside, ["lang", "phrase"], "left")
    return kept.where(F.col("most").isNull() | (100 * F.col("most") < mining.absorbed * F.col("a"))).drop("most")


def best_of_each(candidates: DataFrame, top: int, scratch: Scratch) -> DataFrame:
    """The first ``top`` of each language; groups of bounded size are thinned to these before."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows, step = scratch.save(candidates, "candidates"), 0
    many = rows.count()
    while many > max(RANKED, 4 * top):
        deal = F.pmod(F.xxhash64("phrase"), F.lit(-(-many // max(RANKED, 4 * top))))
        place = F.row_number().over(Window.partitionBy("lang", "_deal").orderBy(*order))
        rows = rows.withColumn("_deal", deal).withColumn("_place", place).where(F.col("_place") <= top).drop("_deal", "_place")
        rows, before, step = scratch.save(rows, f"thinned-{step}"), many, step + 1
        many = rows.count()
        if 2 * many > before:  # very many languages: no group is large
            break
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return rows.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)


def collocations(documents: DataFrame, mining: Mining | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    a, l and r are the occurrences of the phrase and of both sides of its weakest cut, n all
    words of the language, and score is floor(1000 * a * n / (l * r)).
    """
    mining, scratch = mining or Mining(), Scratch(documents.sparkSession)
    phrases, totals = frequent_phrases(documents, mining, scratch)
    phrases = scratch.save(phrases, "phrases")
    scored = weakest_cuts(phrases, totals, scratch)
    kept = without_absorbed(scored, phrases, mining)
    return best_of_each(kept, mining.top, scratch).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
