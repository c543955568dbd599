"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The vocabulary compiles to three machines.  The normaliser has one state: it writes a
space as U+2581 and every other character as it is (and a space before a text).  The
piece machine is a trie whose arcs read characters and give a piece's id where one ends.
The fallback machine reads one character that is no piece and gives its bytes' ids.
``compose`` joins an input with all three to a lattice of arcs over its characters, and
``relax`` finds its shortest path in the tropical semiring: weights are added along a
path, and of the paths into a state the least stays.

Of a vocabulary of scored pieces an arc weighs the piece's negated score, and a state is
a place.  Of a vocabulary of merges a state is a place and the last piece, and going on
with another piece weighs 0 if merging the two pieces alone leaves exactly these two,
else infinity.  The path of finite weight is then unique and equals the result of
merging: no merge crosses the border of two neighbours of the result, so merging any two
neighbours alone gives the same border.

Paths are independent on both sides of a place that no piece spans, so texts are cut
there and every different segment of a batch is composed once.

Defined results: NULL and empty texts have no pieces; U+2581 in a text decodes to a
space, as in the library; ids outside the vocabulary raise; of paths of one weight the
one with the longer piece at the end stays.  Only vocabularies with byte fallback and
without a character map are accepted.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import bytewords as bw
from pagemill.llm.segments import SegmentCache, ragged

SPACE = "▁"
NORMAL, BYTE, UNIGRAM, BPE = 1, 6, 1, 2
#: What a character outside the pieces weighs more than the worst piece, as in the library.
OUTSIDE = 10.0
#: Pairs of pieces that a worker remembers; then it begins anew.
REMEMBERED = 1 << 18


@dataclass
class Vocabulary:
    """Pieces by id, as the public model file has them."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True
    merges: bool = True


def read_vocabulary(path: str) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as formats

    model = formats.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec, trainer = model.normalizer_spec, model.trainer_spec
    fits = trainer.model_type in (UNIGRAM, BPE) and trainer.byte_fallback
    if not fits or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
        raise ValueError("a vocabulary of pieces or merges with byte fallback and without a character map is needed")
    rows = [(p.piece, p.score, p.type) for p in model.pieces]
    return Vocabulary(*(list(x) for x in zip(*rows, strict=True)), spec.add_dummy_prefix, trainer.model_type == BPE)


#: Of the lattice: the place behind the characters read, the piece (-1 in the fallback
#: machine), the ids given, and the weight.
Arc = tuple[int, int, tuple[int, ...], float]


@dataclass
class Transducer:
    """The compiled machines of a vocabulary."""

    vocabulary: Vocabulary
    ids: dict[str, int] = field(init=False)
    arcs: dict = field(init=False)
    byte_ids: list[int] = field(init=False)

    def __post_init__(self) -> None:
        v = self.vocabulary
        self.ids = {p: i for i, (p, kind) in enumerate(zip(v.pieces, v.kinds, strict=True)) if kind == NORMAL}
        self.arcs = {}  # by character; under the empty text the piece that ends there, its ids and its weight
        for piece, i in self.ids.items():
            at = self.arcs
            for c in piece:
                at = at.setdefault(c, {})
            at[""] = (i, (i,), 0.0 if v.merges else -v.scores[i])
        named = {p: i for i, (p, kind) in enumerate(zip(v.pieces, v.kinds, strict=True)) if kind == BYTE}
        self.byte_ids = [named[f"<0x{b:02X}>"] for b in range(256)]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece spans a word border")
        # Two ASCII characters that follow each other in no piece have no piece across them.
        self.apart = np.zeros((256, 256), bool)
        self.apart[:128, :128] = True
        for piece in self.ids:
            raw = piece.replace(SPACE, " ").encode()
            self.apart[list(raw[:-1]), list(raw[1:])] = False
        scores = [v.scores[i] for i in self.ids.values()]
        self.outside = 0.0 if v.merges else OUTSIDE - min(scores, default=0.0)
        self._borders: dict[int, float] = {}
        self.cache = SegmentCache(self._encode)
        raw = [p.replace(SPACE, " ").encode() if kind == NORMAL else b"" for p, kind in zip(v.pieces, v.kinds, strict=True)]
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        self.raw_offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges that the vocabulary defines, best score first, then leftmost."""
        scores, ids = self.vocabulary.scores, self.ids
        while True:
            found = [(-scores[ids[p]], i) for i in range(len(symbols) - 1) if (p := symbols[i] + symbols[i + 1]) in ids]
            if not found:
                return symbols
            i = min(found)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    def border(self, left: int, right: int) -> float:
        """What a merge vocabulary's arc with ``right`` weighs after the piece ``left``."""
        key = left * len(self.vocabulary.pieces) + right
        known = self._borders.get(key)
        if known is None:
            if len(self._borders) >= REMEMBERED:
                self._borders.clear()
            x, y = self.vocabulary.pieces[left], self.vocabulary.pieces[right]
            known = self._borders[key] = 0.0 if self.merged(list(x + y)) == [x, y] else math.inf
        return known

    def normalise(self, text: str) -> str:
        """The output of the normaliser, state by state the same."""
        return text.replace(" ", SPACE)

    def compose(self, text: str) -> list[list[Arc]]:
        """The lattice: arcs by the place where they begin, of the piece and the fallback machine."""
        read, n = self.normalise(text), len(text)
        lattice: list[list[Arc]] = []
        for i in range(n):
            found, at, stop = [], self.arcs, i
            while stop < n and (at := at.get(read[stop])) is not None:
                stop += 1
                if "" in at:
                    found.append((stop, *at[""]))
            if not found or found[0][0] > i + 1:  # no piece is this character alone
                found.append((i + 1, -1, tuple(self.byte_ids[b] for b in read[i].encode()), self.outside))
            lattice.append(found)
        return lattice

    def relax(self, lattice: list[list[Arc]]) -> list[int]:
        """Ids of the shortest path from the first place to the last.

        A merge vocabulary's machine is unambiguous: one path to a place has a finite
        weight, so arcs to a place that has its path are not weighed any more.
        """
        merges, border = self.vocabulary.merges, self.border
        # By place: state -> (weight, place before, state before, ids of the arc).
        best: list[dict[int, tuple]] = [{} for _ in range(len(lattice) + 1)]
        best[0][-1] = (0.0, 0, -1, ())
        for i, arcs in enumerate(lattice):
            for state, (weight, *_) in best[i].items():
                for end, piece, ids, own in arcs:
                    there, to, total = best[end], -1, weight + own
                    if merges:
                        if there:
                            continue
                        to = piece
                        if state >= 0 <= piece:
                            total += border(state, piece)
                    if total < (there[to][0] if to in there else math.inf):
                        there[to] = (total, i, state, ids)
        path: list[tuple[int, ...]] = []
        at = len(lattice)
        state = min(best[at], key=lambda s: best[at][s][0]) if at else -1
        while at:
            _, at, state, ids = best[at][state]
            path.append(ids)
        return [x for ids in reversed(path) for x in ids]

    def shortest_path(self, text: str) -> list[int]:
        return self.relax(self.compose(text))

    def _encode(self, segments: list[str]) -> list[list[int]]:
        return [self.shortest_path(s) for s in segments]

    def encode_chunk(self, chunk: bw.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Offsets and ids by text, and the normalised bytes with their offsets."""
        lengths = np.diff(chunk.offsets)
        some = lengths > 0
        add = some & self.vocabulary.dummy_prefix
        data = np.insert(chunk.data, chunk.offsets[:-1][add], 32)
        offsets = chunk.offsets + np.concatenate([[0], np.cumsum(add)])
        begins = np.zeros(len(data) + 1, bool)
        blank = data == 32
        spaced = blank.copy()  # a written U+2581 is a space too
        spaced[2:] |= (data[2:] == 0x81) & (data[1:-1] == 0x96) & (data[:-2] == 0xE2)
        begins[1:-1] = blank[1:] & ~spaced[:-1]
        begins[1:-1] |= self.apart[data[:-1], data[1:]]
        begins[offsets[:-1]] = True
        begins[-1] = False
        starts = np.flatnonzero(begins)
        bounds, ids = self.cache.encode_all(data, starts, offsets)
        return bounds, ids, data, offsets

    def decoded_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and where those of each id begin."""
        sizes = np.diff(self.raw_offsets)[ids]
        return self.raw[ragged(self.raw_offsets[ids], sizes)], np.concatenate([[0], np.cumsum(sizes)])

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, the leading space goes."""
        body = self.decoded_bytes(np.asarray(ids, np.int64))[0].tobytes()
        text = body.decode(errors="replace")
        return text[1:] if self.vocabulary.dummy_prefix and text.startswith(" ") else text


_compiled: dict[int, Transducer] = {}


def compiled(vocabulary: Vocabulary) -> Transducer:
    """One transducer for each worker, the last one asked for; what it remembers is bounded in bytes."""
    key = hash((len(vocabulary.pieces), *vocabulary.pieces[-100:]))
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(vocabulary)
    return _compiled[key]


def encode(documents: DataFrame, vocabulary: Vocabulary, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) with ``piece_ids``, ``n_pieces`` and ``round_trip``.

    ``round_trip`` says that decoding the ids gives the normalised text byte by byte.
    Columns of these names are replaced.
    """
    new = ("piece_ids", "n_pieces", "round_trip")
    kept = [c for c in keep or documents.columns if c not in new]
    rows = documents.select(*dict.fromkeys([*kept, "text"]))
    held = documents.sparkSession.sparkContext.broadcast(vocabulary)
    out = rows.select(*kept, F.array().cast("array<int>").alias("piece_ids"), F.lit(0).alias("n_pieces"), F.lit(True).alias("round_trip")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(held.value)
        for batch in batches:
            for chunk in bw.chunks(batch["text"]):
                bounds, ids, data, offsets = machine.encode_chunk(chunk)
                back, at = machine.decoded_bytes(ids)
                same = len(back) == len(data) and bool((back == data).all())
                trips = [same or back[at[a] : at[b]].tobytes() == data[x:y].tobytes() for a, b, x, y in zip(bounds[:-1], bounds[1:], offsets[:-1], offsets[1:], strict=True)]
                part = slice(chunk.first, chunk.first + len(chunk))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c][part] for c in kept), lists, pa.array(np.diff(bounds).astype(np.int32)), pa.array(trips, pa.bool_())],
                    names=[*kept, *new],
                )

    return rows.mapInArrow(run, out)


def decode(encoded: DataFrame, vocabulary: Vocabulary, column: str = "piece_ids") -> DataFrame:
    """``encoded`` with the text of its ids as ``decoded``; NULL ids give NULL."""
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [c for c in encoded.columns if c != "decoded"]
    out = encoded.select(*kept, F.lit("").cast("string").alias("decoded")).schema
    out["decoded"].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(held.value)
        for batch in batches:
            texts = [None if x is None else machine.decode(x) for x in batch[column].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(texts, pa.string())], names=[*kept, "decoded"])

    return encoded.select(*kept).mapInArrow(run, out)
