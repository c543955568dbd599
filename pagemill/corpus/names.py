"""Names: spellings that are close, and where names of a dictionary stand in texts."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.sources.scratch import Scratch

#: Signs that may separate the words of a name, and what a word is.
WORD = "[^\\x20\\x09-\\x0D.,;:!?]+"


def canonical(name: Column) -> Column:
    """Lower case (A-Z), words joined by one space."""
    lower = F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat_ws(" ", F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)))


def _without(text: Column, i: Column) -> Column:
    """A text without its i-th character, from 1."""
    return F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.char_length(text)))


def deletions(name: Column, most: int) -> Column:
    """Hashes of ``name`` and of what is left of it without up to ``most`` characters.

    Two names within ``most`` edits have one of them in common: the characters that an
    edit touches are gone on both sides.  A name of n characters has about n**most.
    """
    variants = F.array(name)
    step = variants
    for _ in range(most):
        places = lambda v: F.sequence(F.lit(1), F.char_length(v))
        cut = lambda v: F.when(F.char_length(v) > 0, F.transform(places(v), lambda i, v=v: _without(v, i))).otherwise(F.array().cast("array<string>"))
        step = F.array_distinct(F.flatten(F.transform(step, cut)))
        variants = F.concat(variants, step)
    return F.array_distinct(F.transform(variants, lambda v: F.xxhash64(v)))


def _meeting(listed: DataFrame, scratch: Scratch, near: Column) -> DataFrame:
    """(name_a, name_b): the pairs of ``listed`` (name, size, variant) in one list for which ``near`` holds.

    Short lists give pairs.  Of a list over ``LONG`` each name is dealt to one of several
    slots and meets the others slot by slot, so that no task holds a whole list.
    """
    long = listed.groupBy("variant").agg(F.count("*").alias("m")).where("m > 1")
    long = scratch.save(long.withColumn("slots", F.ceil(F.col("m") / LONG).cast("int")), "lists")
    shared = listed.join(long.select("variant", "slots"), "variant")
    mine = F.pmod(F.xxhash64("name"), F.col("slots")).cast("int")
    left = shared.select("variant", mine.alias("slot"), F.col("name").alias("name_a"), F.col("size").alias("size_a"))
    every = F.explode(F.sequence(F.lit(0), F.col("slots") - 1))
    right = shared.select("variant", every.alias("slot"), F.col("name").alias("name_b"), F.col("size").alias("size_b"))
    return left.join(right, ["variant", "slot"]).where((F.col("name_a") < F.col("name_b")) & near).select("name_a", "name_b")


def _one_edit(known: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs within one edit.  Names of one length lose the character at the same place, so the
    place is part of what they meet at; of two lengths the shorter one is a variant of the longer."""
    places = F.posexplode(F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: _without(F.col("name"), i))).alias("place", "rest")
    cut = scratch.save(known.select("name", "size", places), "cut")
    replaced = cut.select("name", "size", F.xxhash64("rest", "place").alias("variant"))
    longer = cut.select(F.col("name").alias("long"), "rest").distinct()
    inserted = longer.join(known.select(F.col("name").alias("short")), F.col("rest") == F.col("short"))
    inserted = inserted.select(F.least("long", "short").alias("name_a"), F.greatest("long", "short").alias("name_b"))
    return _meeting(replaced, scratch, F.col("size_a") == F.col("size_b")).union(inserted)


def similar_names(names: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """(name_a, name_b, distance, n_a, n_b): pairs of different names within ``most`` edits, a before b.

    ``names`` has a column ``name``; a NULL or blank one is left out, equal ones are one
    name with a number of rows.  Pairs meet at equal deletion variants, not in blocks by a
    part of the name, so a list is as long as the names are really alike.  For one edit
    lists hold names that differ at one place only; for more, names within 2 * ``most``
    edits of each other.  Pairs are verified by their edit distance.
    """
    known = names.select(canonical(F.col("name")).alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n"))
    known = scratch.save(known.withColumn("size", F.char_length("name")), "known")
    if most == 1:
        met = _one_edit(known, scratch)
    else:
        listed = scratch.save(known.select("name", "size", F.explode(deletions(F.col("name"), most)).alias("variant")), "listed")
        met = _meeting(listed, scratch, F.abs(F.col("size_a") - F.col("size_b")) <= most)
    distance = F.levenshtein("name_a", "name_b", most)
    pairs = met.distinct().withColumn("distance", distance).where("distance >= 0")
    count = lambda side: known.select(F.col("name").alias(f"name_{side}"), F.col("n").alias(f"n_{side}"))
    return pairs.join(count("a"), "name_a").join(count("b"), "name_b").select("name_a", "name_b", "distance", "n_a", "n_b")


#: Names of one deletion variant that meet in one task.
LONG = 4096
#: Words of a dictionary that the tasks get as a trie.
HELD = 1 << 20


class Trie:
    """Names as sorted arrays: a node of n words is known by the node of the words before it and the last word."""

    def __init__(self, entities: list[str]):
        split = [e.split(" ") for e in entities]
        vocabulary = sorted({w for words in split for w in words})
        number = {w: i for i, w in enumerate(vocabulary)}
        self.words, self.entities = pa.array(vocabulary, pa.string()), pa.array(entities, pa.string())
        self.keys, self.name = [], []  # of the nodes of each size: sorted keys, and the name that ends there or -1
        going = [(0, i) for i in range(len(split))]  # (node of the words so far, name)
        while going:
            size = len(self.keys)
            here = np.array([node * len(vocabulary) + number[split[i][size]] for node, i in going], np.int64)
            keys, nodes = np.unique(here, return_inverse=True)
            name = np.full(len(keys), -1, np.int64)
            for node, (_, i) in zip(nodes.tolist(), going, strict=True):
                if len(split[i]) == size + 1:
                    name[node] = i
            going = [(node, i) for node, (_, i) in zip(nodes.tolist(), going, strict=True) if len(split[i]) > size + 1]
            self.keys.append(keys)
            self.name.append(name)

    def longest(self, words: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places where names begin, with the size and number of the longest; ``ends`` is where the text of each word ends."""
        number = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().astype(np.int64)
        size, name = np.zeros(len(number), np.int64), np.full(len(number), -1, np.int64)
        at, node = np.arange(len(number)), np.zeros(len(number), np.int64)
        for n, (keys, names) in enumerate(zip(self.keys, self.name, strict=True)):
            inside = at + n < ends[at]
            at, node = at[inside], node[inside]
            word = number[at + n]
            key = node * len(self.words) + word
            node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            found = (word >= 0) & (keys[node] == key)
            at, node = at[found], node[found]
            whole = names[node] >= 0
            size[at[whole]], name[at[whole]] = n + 1, names[node[whole]]
        begin = np.flatnonzero(size)
        return begin, size[begin], name[begin]


def trie(entities: DataFrame) -> DataFrame:
    """(entity, words, size, first): the names of ``entities`` (column ``name``) by their first word.

    Names that are equal in canonical form are one entity; NULL and blank ones are left out.
    """
    found = entities.select(canonical(F.col("name")).alias("entity")).where("entity <> ''").distinct()
    words = F.split("entity", " ")
    return found.select("entity", words.alias("words"), F.size(words).alias("size"), F.get(words, F.lit(0)).alias("first"))


def dictionary_entities(documents: DataFrame, entities: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, start, size, entity): names in texts, by words, leftmost first and then longest.

    A place where a name may begin, one with a first word of the dictionary, goes on with
    the few words after it that the longest name asks for, and meets the names with this
    first word; of those that fit the longest stays.  Matches of a row are then taken in
    order, and one that begins inside the match before it is dropped.  ``start`` counts
    words from 0.  Sentence marks separate words and are not part of them, so a name may
    stand across a mark.  Every row is matched by itself; NULL texts have no names.

    A dictionary of up to ``HELD`` words goes to the tasks, and a text is matched in the
    one that reads it.  Beyond that its places and the names are two tables that are joined.
    """
    names = scratch.save(trie(entities), "names")
    longest, n_words = names.agg(F.max("size"), F.sum("size")).first()
    if (n_words or 0) <= HELD:
        return _held_entities(documents, names.select("entity").toArrow()["entity"].to_pylist())
    return _joined_entities(documents, names, longest)


def _words(text: str) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _held_entities(documents: DataFrame, entities: list[str]) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(Trie(entities))
    rows = documents.select("doc_id", F.coalesce(_words("text"), F.array().cast("array<string>")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch["w"].offsets.to_numpy().astype(np.int64)
            words = batch["w"].values.slice(offsets[0], offsets[-1] - offsets[0])
            offsets -= offsets[0]
            sizes = np.diff(offsets)
            begin, size, name = held.value.longest(words, np.repeat(offsets[1:], sizes))
            # No match reaches into the next text, so one pass from left to right does for all.
            end, kept = 0, []
            for i, (at, n) in enumerate(zip(begin.tolist(), size.tolist(), strict=True)):
                if at >= end:
                    kept.append(i)
                    end = at + n
            kept = np.array(kept, np.int64)
            row = np.searchsorted(offsets, begin[kept], "right") - 1
            columns = [batch["doc_id"].take(pa.array(row)), pa.array((begin[kept] - offsets[row]).astype(np.int32))]
            columns += [pa.array(size[kept].astype(np.int32)), held.value.entities.take(pa.array(name[kept]))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "size", "entity"])

    kind = documents.select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit("").alias("entity")).schema
    return rows.mapInArrow(run, kind)


def _joined_entities(documents: DataFrame, names: DataFrame, longest: int) -> DataFrame:
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", _words("text").alias("w"))
    ahead = F.transform("w", lambda x, i: F.struct(i.alias("start"), x.alias("first"), F.slice("w", i + 1, F.lit(longest)).alias("ahead")))
    places = rows.select("row", "doc_id", F.explode(ahead).alias("p")).select("row", "doc_id", "p.*")
    fits = F.slice("ahead", F.lit(1), F.col("size")) == F.col("words")
    met = places.join(names, "first").where(fits).select("row", "doc_id", "start", F.struct("size", "entity").alias("match"))
    # One row holds a document's matches: as many as it has words, at most.
    match = F.struct("start", F.col("match.size").alias("size"), F.col("match.entity").alias("entity"))
    of_row = met.groupBy("row", "doc_id").agg(F.collect_list(F.struct("start", "match.size", "match.entity")).alias("all"))
    kind = "array<struct<start:int,size:int,entity:string>>"
    kept = of_row.select("doc_id", "all").mapInArrow(_in_order, of_row.select("doc_id", F.array().cast(kind).alias("all")).schema)
    return kept.select("doc_id", F.explode("all").alias("m")).select("doc_id", "m.*")


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a row's matches, from left to right, the longest of each place that is free."""
    for batch in batches:
        kept = []
        for matches in batch["all"].to_pylist():
            end, mine = 0, []
            for m in sorted(matches, key=lambda m: (m["start"], -m["size"])):
                if m["start"] >= end:
                    mine.append(m)
                    end = m["start"] + m["size"]
            kept.append(mine)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(kept, batch.schema.field("all").type)], names=["doc_id", "all"])
