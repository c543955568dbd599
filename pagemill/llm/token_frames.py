"""Token ids of documents in seekable files of independent zstandard frames.

A file is a valid zstandard stream: frames with the little-endian ids of some whole
documents each and a checksum of their own, then a skippable frame with the seek
table, which says for each document its id, frame, first token and length, and for
each frame its place, sizes and crc32.  Its last bytes give its length and crc32, so
a reader finds the table from the end and decompresses only frames it needs.

Documents are sorted over the cluster by doc_id, every task writes one file, frame by
frame, through Spark's committer: a lost task is written again and a file appears once.
Spark's text sink writes the bytes as they are and ends each row with ``GAP``, an
empty skippable frame, so any file system that Spark writes to will do.

Defined results: a NULL text is empty and has only the end id; a NULL doc_id comes
first; rows with equal doc_id follow in the order of their texts' hashes and are
documents of their own; a text longer than a frame's measure has a frame to itself;
an empty table gives no files and reads back as no rows.
"""

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm import bytewords as bw
from pagemill.llm.common import Scratch, batches_of
from pagemill.llm.segments import SegmentCache

SKIPPABLE = 0x184D2A50
GAP = "P*M\x18\0\0\0\0"
_TAIL = struct.Struct("<II4s")  # bytes of the table, its crc32, mark
_MARK = b"TKFR"
_FRAME = np.dtype([("at", "<u8"), ("size", "<u4"), ("raw", "<u8"), ("crc", "<u4"), ("first", "<u8")])
_DOC = np.dtype([("id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("token", "<u8"), ("n", "<u8")])


@dataclass(frozen=True)
class Format:
    """``frame_tokens`` in a frame, about; ``file_bytes`` of text in a file, about."""

    end_id: int = 2
    frame_tokens: int = 1 << 16
    file_bytes: int = 32 << 20
    level: int = 3


class Encoder:
    """A byte-level merge tokenizer that remembers the segments it has seen.

    Its pattern never joins what is on both sides of a space or a lone line end
    before a visible character, nor a letter with a sign after it but an apostrophe,
    so texts are cut there.  The string of an added token in a text is that token, as
    by the library's default: a segment by itself, which what is around it never joins.
    """

    #: New segments that are encoded in one text.
    TOGETHER = 4096

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.cache = SegmentCache(self._encode)
        added = json.loads(definition).get("added_tokens") or []
        for t in added:
            if t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]):
                raise ValueError(f"added token {t['content']!r} depends on the space around it or in it")
        contents = sorted((t["content"].encode() for t in added), key=len, reverse=True)  # the longest wins
        self.added = re.compile(b"|".join(map(re.escape, contents))) if contents else None
        lengths = {i: len(token) for token, i in self.tokenizer.get_vocab().items()}  # a character is a byte
        lengths |= {t["id"]: len(t["content"].encode()) for t in added}
        self.token_bytes = np.array([lengths.get(i, 0) for i in range(max(lengths) + 1)], np.int64)
        self.letter = np.zeros(256, bool)
        self.letter[[*range(65, 91), *range(97, 123)]] = True
        self.sign = np.zeros(256, bool)
        self.sign[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = True
        visible = np.zeros(256, bool)
        visible[0x21:0x7F] = True
        self.before = visible
        self.after = visible.copy()
        self.after[0xC3:0xF5] = True
        self.after[[0xE1, 0xE2, 0xE3]] = False  # these may begin a space of Unicode

    def _encode(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment; those that may stand in a line are encoded together.

        A segment with a space in front follows another as it is, one without follows a
        line end.  The ends of tokens show where each segment ends; if one does not fall
        on a token's end, the segments are encoded one by one.
        """
        plain = [not (s[-1].isspace() or s[0].isspace() and (s[0] != " " or s[1].isspace())) for s in segments]
        out: list[list[int]] = [[]] * len(segments)
        alone = [i for i, ok in enumerate(plain) if not ok]
        together = [i for i, ok in enumerate(plain) if ok]
        groups = [together[k : k + self.TOGETHER] for k in range(0, len(together), self.TOGETHER)]
        texts = [[segments[i] if segments[i][0] == " " else "\n" + segments[i] for i in group] for group in groups]
        for group, parts, found in zip(groups, texts, self._ids(["".join(x) for x in texts]), strict=True):
            ends = np.cumsum(np.fromiter((len(x.encode()) for x in parts), np.int64, len(parts)))
            at = np.cumsum(self.token_bytes[found])
            stops = np.searchsorted(at, ends)
            if not len(at) or (at[np.minimum(stops, len(at) - 1)] != ends).any():
                alone += group
                continue
            first = 0
            for i, part, stop in zip(group, parts, (stops + 1).tolist(), strict=True):
                out[i] = found[first + (part[0] == "\n") : stop]
                first = stop
        for i, found in zip(alone, self._ids([segments[i] for i in alone]), strict=True):
            out[i] = found
        return out

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _marks(self, chunk: bw.Chunk) -> np.ndarray:
        """Begin and end of each added token in the texts; none reaches from one text into the next."""
        body, found = chunk.data.tobytes(), []
        if self.added and self.added.search(body):
            found = [m.span() for a, b in pairwise(chunk.offsets.tolist()) for m in self.added.finditer(body, a, b)]
        return np.array(found, np.int64).reshape(-1, 2)

    def encode_chunk(self, chunk: bw.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Bounds by text, and ids."""
        data = chunk.data
        begins = np.zeros(len(data) + 1, bool)
        if len(data) > 2:
            follows = self.after[data[1:]]
            begins[:-2] |= (data[:-1] == 32) & follows
            line = (data[1:-1] == 10) & self.before[data[:-2]] & follows[1:]
            begins[1:-2] |= line
            begins[2:-1] |= line
            begins[1:-1] |= self.letter[data[:-1]] & self.sign[data[1:]]
        marks = self._marks(chunk)
        if len(marks):
            depth = np.zeros(len(begins), np.int8)
            depth[marks[:, 0]] += 1
            depth[marks[:, 1]] -= 1
            begins &= np.cumsum(depth, dtype=np.int8) == 0
            # A space before a token ends a text, and stays with spaces before it.
            last = marks[:, 0] - 1
            begins[last[(last >= 0) & (data[last] == 32)]] = False
            begins[marks] = True
        begins[chunk.offsets[:-1]] = True
        begins[-1] = False
        return self.cache.encode_all(data, np.flatnonzero(begins), chunk.offsets)


_encoders: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    key = zlib.crc32(definition.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(definition)
    return _encoders[key]


class FrameWriter:
    """The parts of one file, in order; the caller puts GAP after each."""

    def __init__(self, form: Format):
        self.form, self.at = form, 0
        self.frames: list[tuple] = []
        self.docs: list[tuple] = []
        self.pending: list[np.ndarray] = []
        self.n_pending = self.first = 0
        self.squeeze = zstandard.ZstdCompressor(level=form.level, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        if self.n_pending and self.n_pending + len(ids) > self.form.frame_tokens:
            yield self.flush()
        self.docs.append((doc_id or 0, doc_id is not None, len(self.frames), self.n_pending, len(ids)))
        self.pending.append(ids.astype("<u4"))
        self.n_pending += len(ids)

    def flush(self) -> bytes:
        raw = np.concatenate(self.pending).tobytes()
        body = self.squeeze.compress(raw)
        self.frames.append((self.at, len(body), len(raw), zlib.crc32(raw), self.first))
        self.at += len(body) + len(GAP)
        self.first += self.n_pending
        self.pending, self.n_pending = [], 0
        return body

    def close(self) -> Iterator[bytes]:
        if self.pending:
            yield self.flush()
        table = struct.pack("<II", len(self.frames), len(self.docs))
        table += np.array(self.frames, _FRAME).tobytes() + np.array(self.docs, _DOC).tobytes()
        table += _TAIL.pack(len(table), zlib.crc32(table), _MARK)
        yield struct.pack("<II", SKIPPABLE + 1, len(table)) + table


class FrameReader:
    """A file's documents by number or id; ``source`` has seek and read."""

    def __init__(self, source):
        self.source = source
        tail = len(GAP) + _TAIL.size
        source.seek(-tail, 2)
        size, crc, mark = _TAIL.unpack(source.read(_TAIL.size))
        if mark != _MARK:
            raise ValueError("no seek table at the end")
        source.seek(-(tail + size), 2)
        table = source.read(size)
        if zlib.crc32(table) != crc:
            raise ValueError("the seek table is damaged")
        n_frames, n_docs = struct.unpack_from("<II", table)
        self.frames = np.frombuffer(table, _FRAME, n_frames, 8)
        self.docs = np.frombuffer(table, _DOC, n_docs, 8 + n_frames * _FRAME.itemsize)
        self.decompressed = 0

    def __len__(self) -> int:
        return len(self.docs)

    def frame(self, k: int) -> np.ndarray:
        about = self.frames[k]
        self.source.seek(int(about["at"]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(about["size"])))
        self.decompressed += 1
        if zlib.crc32(raw) != about["crc"] or len(raw) != about["raw"]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def start(self, i: int) -> int:
        """Ids of all documents of the file before this one."""
        return int(self.frames[self.docs[i]["frame"]]["first"] + self.docs[i]["token"])

    def read(self, numbers) -> Iterator[tuple[int, int | None, np.ndarray]]:
        """(number, doc_id, ids) of documents in ascending order; each needed frame is read once."""
        held, ids = -1, None
        for i in numbers:
            doc = self.docs[i]
            if doc["frame"] != held:
                held = int(doc["frame"])
                ids = self.frame(held)
            token, n = int(doc["token"]), int(doc["n"])
            yield int(i), int(doc["id"]) if doc["known"] else None, ids[token : token + n]


def write(documents: DataFrame, definition: str, path: str, form: Format | None = None) -> None:
    """Encode and write all documents in ascending doc_id order."""
    form, spark = form or Format(), documents.sparkSession
    size = documents.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n_files = max(1, -(-((size[0] or 0) + 8 * size[1]) // form.file_bytes))
    held = spark.sparkContext.broadcast(definition)
    # The last key tells repeated rows apart, so that many of them do not meet in one task.
    order = ["doc_id", "_hash", "_row"]
    rows = documents.select(
        F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row")
    )
    sorted_rows = rows.repartitionByRange(n_files, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = encoder(held.value), FrameWriter(form)
        end = np.array([form.end_id], np.int32)

        def rows_of(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
            yield from batches_of({"body": parts}, pa.schema([("body", pa.binary())]))

        for batch in batches:
            doc_ids = batch["doc_id"].to_pylist()
            for chunk in bw.chunks(batch["text"]):
                bounds, ids = own.encode_chunk(chunk)
                for i in range(len(chunk)):
                    for part in out.add(doc_ids[chunk.first + i], np.append(ids[bounds[i] : bounds[i + 1]], end)):
                        yield from rows_of([part])
        if out.docs:
            yield from rows_of(list(out.close()))

    # A cast keeps the bytes; each row is a part of the file.
    parts = sorted_rows.mapInArrow(run, "body binary").select(F.col("body").cast("string").alias("value"))
    parts.write.option("lineSep", GAP).option("maxRecordsPerFile", 0).option("compression", "none").mode("overwrite").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def read(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """(file, number, doc_id, ids) of all documents, or of those with the ids ``wanted``.

    Only frames with wanted documents are decompressed.
    """
    kind = pa.schema([("file", pa.string()), ("number", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, body in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                reader = FrameReader(pa.BufferReader(body.as_buffer()))
                numbers = range(len(reader))
                if wanted is not None:
                    numbers = np.flatnonzero(np.isin(reader.docs["id"], wanted) & (reader.docs["known"] == 1))
                for i, doc_id, ids in reader.read(numbers):
                    yield from batches_of({"file": [file], "number": [i], "doc_id": [doc_id], "ids": [ids.astype(np.int32)]}, kind)

    return _files(spark, path).mapInArrow(run, "file string, number long, doc_id long, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the decompressed files.

    ``start`` is the number of ids in all documents before; the files are in the order
    of their part numbers, and their totals are one row each.
    """
    kind = pa.schema(
        [("file", pa.string()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, body in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                reader = FrameReader(pa.BufferReader(body.as_buffer()))
                rows = [(file, d, reader.start(i), len(x), zlib.crc32(x.tobytes())) for i, d, x in reader.read(range(len(reader)))]
                yield from batches_of(dict(zip(kind.names, map(list, zip(*rows, strict=True)), strict=True)), kind)

    scratch = Scratch(spark)
    rows = _files(spark, path).mapInArrow(run, "file string, doc_id long, local long, n_tokens long, ids_crc32 long")
    rows = scratch.save(rows, "digests")
    part = F.regexp_extract("file", "part-(\\d+)", 1).cast("long")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(starts, "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
