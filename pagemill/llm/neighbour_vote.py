"""Quality classifier: similarity-weighted votes of the nearest labelled texts.

A text becomes counts of character-shape trigrams, hashed words and repetition
marks; a truncated singular value decomposition of a labelled sample turns these
into latent-semantic vectors.  Model and sample are broadcast (their size is
fixed by ``Settings``), every document's vector is multiplied with all sample
vectors in blocks, and its ``neighbours`` nearest vote with their labels,
weighted by cosine.

Defined results: a NULL or blank text has no vector and gets the share of label 1
in the sample's training rows as score; NULL labels and labels of missing
documents teach nothing; several labels of one document count by their mean;
repeated document rows are scored each; without any label of both kinds every
score is that share, or 0.5 without labels.  Ties between neighbours go to the
earlier sample row.  Labels, language, source and id are never inputs of a score.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import bytewords as bw
from pagemill.llm.common import batches_of

SHAPES, WORDS, MARKS = 1024, 1024, 4
FEATURES = SHAPES + WORDS + MARKS
#: Share of each block in the squared length of a vector.
BLOCK_WEIGHTS = (0.5, 0.1, 0.4)
#: Documents whose products with the sample are in memory together, and whose features are.
BLOCK, CHUNK_TEXTS = 256, 1024


@dataclass(frozen=True)
class Settings:
    """Bounds of the model: ``per_label`` sample rows of each label, at most."""

    per_label: int = 2048
    rank: int = 64
    neighbours: int = 15
    sharpness: float = 8.0  # votes weigh cosine to this power


@dataclass
class Model:
    scale: np.ndarray  # by feature
    basis: np.ndarray  # features x rank
    vectors: np.ndarray  # sample x rank, unit length
    labels: np.ndarray
    prior: float
    settings: Settings


def _shape_classes() -> np.ndarray:
    """Letters by case, digits, spaces, line ends; every other sign by itself."""
    kinds = np.ones(256, np.int64)
    kinds[65:91] = 2
    kinds[48:58] = 3
    kinds[list(bw.WHITE)] = 4
    kinds[10] = 5
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    kinds[signs] = 6 + np.arange(len(signs))
    return kinds


_KINDS = _shape_classes()
_N_KINDS = int(_KINDS.max()) + 1
_SHAPE_SLOT = (bw.mix(np.arange(_N_KINDS**3, dtype=np.uint64)) % np.uint64(SHAPES)).astype(np.int64)


def _repeats(chunk: bw.Chunk, words: np.ndarray) -> np.ndarray:
    """For each text: words, words equal to the one before, lines, lines seen before."""
    n, owner = len(chunk), chunk.word_texts()
    again = owner[1:][(words[1:] == words[:-1]) & (owner[1:] == owner[:-1])] if len(words) else owner
    breaks = np.flatnonzero(chunk.data == 10)
    starts = np.unique(np.concatenate([chunk.offsets[:-1], breaks + 1]))
    starts = starts[starts < len(chunk.data)]
    ends = np.append(starts[1:], len(chunk.data))
    has_word = np.searchsorted(chunk.starts, starts) < np.searchsorted(chunk.starts, ends)
    starts, ends = starts[has_word], ends[has_word]
    ends = ends - (chunk.data[ends - 1] == 10) if len(ends) else ends
    line_owner = np.searchsorted(chunk.offsets, starts, "right") - 1
    keys = bw.mix(chunk.segment_hashes(starts, ends) + bw.mix(line_owner.astype(np.uint64)))
    first = np.unique(keys, return_index=True)[1] if len(keys) else np.zeros(0, np.int64)
    seen = np.ones(len(keys), bool)
    seen[first] = False
    count = lambda x: np.bincount(x, minlength=n)
    return np.stack([count(owner), count(again), count(line_owner), count(line_owner[seen])], 1).astype(np.float32)


def features(chunk: bw.Chunk) -> np.ndarray:
    """Texts x FEATURES: square roots of shares, so each block has length one or zero."""
    n = len(chunk)
    out = np.zeros((n, FEATURES), np.float32)
    lengths = np.diff(chunk.offsets)
    if len(chunk.data) >= 3:
        kinds = _KINDS[chunk.data]
        slots = _SHAPE_SLOT[(kinds[:-2] * _N_KINDS + kinds[1:-1]) * _N_KINDS + kinds[2:]]
        owner = np.repeat(np.arange(n), lengths)
        inside = owner[:-2] == owner[2:]
        out[:, :SHAPES] = np.bincount(owner[:-2][inside] * SHAPES + slots[inside], minlength=n * SHAPES).reshape(n, SHAPES)
    words = chunk.word_hashes()
    slots = (words % np.uint64(WORDS)).astype(np.int64)
    out[:, SHAPES : SHAPES + WORDS] = np.bincount(chunk.word_texts() * WORDS + slots, minlength=n * WORDS).reshape(n, WORDS)
    for block in (out[:, :SHAPES], out[:, SHAPES : SHAPES + WORDS]):
        block /= np.maximum(block.sum(1, keepdims=True), 1)
    n_words, again, lines, seen = _repeats(chunk, words).T
    repeated, copied = again / np.maximum(n_words, 1), seen / np.maximum(lines, 1)
    some = n_words > 0
    out[:, -4:] = np.stack([repeated, some - repeated, copied, some - copied], 1) / 2
    np.sqrt(out, out=out)
    for block, weight in zip((out[:, :SHAPES], out[:, SHAPES : SHAPES + WORDS], out[:, -4:]), BLOCK_WEIGHTS, strict=True):
        block *= np.sqrt(np.float32(weight))
    out[~some] = 0
    return out


def fit_arrays(x: np.ndarray, labels: np.ndarray, share: dict[int, float], settings: Settings) -> Model:
    """Scale by inverse document frequency, then project on the leading singular vectors."""
    prior = share.get(1, 0.0) / max(sum(share.values()), 1e-9) if share else 0.5
    seen = (x > 0).mean(0) if len(x) else np.zeros(FEATURES)
    scale = (1 + np.log(1 / np.maximum(seen, 1 / max(len(x), 1)))).astype(np.float32)
    scale[-MARKS:] = 1
    x = x * scale
    rank = min(settings.rank, *x.shape) if len(x) else 1
    rng = np.random.default_rng(7)
    q = rng.standard_normal((FEATURES, rank)).astype(np.float32)
    for _ in range(6):  # subspace iteration
        q = np.linalg.qr(x.T @ (x @ q))[0].astype(np.float32) if len(x) else q
    vectors = _unit(x @ q)
    return Model(scale, q, vectors, labels.astype(np.float32), float(prior), settings)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(length > 0, length, 1)).astype(np.float32)


def votes(model: Model, x: np.ndarray) -> np.ndarray:
    """Scores of feature rows against every sample row."""
    out = np.full(len(x), model.prior)
    if not len(model.vectors):
        return out
    k = min(model.settings.neighbours, len(model.vectors))
    nonblank = np.flatnonzero(x.any(1))
    for first in range(0, len(nonblank), BLOCK):
        some = nonblank[first : first + BLOCK]
        near = np.maximum(_unit((x[some] * model.scale) @ model.basis) @ model.vectors.T, 0)
        best = _nearest(near, k)
        weight = np.take_along_axis(near, best, 1).astype(np.float64) ** model.settings.sharpness
        total = weight.sum(1)
        share = (weight * model.labels[best]).sum(1) / np.where(total > 0, total, 1)
        out[some] = np.where(total > 0, np.clip(share, 0, 1), model.prior)
    return out


def _nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest values of each row; of equal ones at the end, the first."""
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(near, best, 1).min(1)
    tied = np.flatnonzero((near >= least[:, None]).sum(1) > k)  # more columns than k reach the least of them
    for i in tied:
        best[i] = np.argsort(-near[i], kind="stable")[:k]
    return best


def training_rows(documents: DataFrame, labels: DataFrame, settings: Settings) -> tuple[DataFrame, dict[int, float]]:
    """At most ``per_label`` documents of each label, chosen by hash, and the share of each label.

    Only rows whose crc32 of the id leaves a remainder other than 1 by 3 are seen.
    """
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("label"))
    )
    share = {int(r[0]): float(r[1]) for r in known.groupBy(F.round("label").cast("int")).count().collect()}
    chosen = None
    for label in (0, 1):
        part = known.where(F.round("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 x per_label rows of two numbers.
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")), share


def fit(documents: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Learn the model; the driver gets 2 x per_label rows of FEATURES numbers at most."""
    settings = settings or Settings()
    rows, share = training_rows(documents, labels, settings)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.float64()), ("x", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in bw.chunks(batch["text"], max_texts=CHUNK_TEXTS):
                part = slice(chunk.first, chunk.first + len(chunk))
                yield from batches_of(
                    {
                        "doc_id": batch["doc_id"][part],
                        "label": batch["label"][part],
                        "x": [r.astype(np.float16).tobytes() for r in features(chunk)],
                    },
                    schema,
                )

    got = rows.mapInArrow(encode, "doc_id long, label double, x binary").collect()
    got.sort(key=lambda r: r[0])
    x = np.frombuffer(b"".join(r[2] for r in got), np.float16).reshape(len(got), FEATURES).astype(np.float32)
    return fit_arrays(x, np.array([r[1] for r in got]), share, settings)


def score(documents: DataFrame, model: Model, keep: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """The columns ``keep`` (all) with ``score`` and ``predicted`` for every row; columns of these names are replaced.

    Rows that score less than ``least`` are left out, before they go back from Python.
    """
    kept = [c for c in keep or documents.columns if c not in ("score", "predicted")]
    rows = documents.select(*dict.fromkeys([*kept, "text"]))
    held = documents.sparkSession.sparkContext.broadcast(model)
    out = rows.select(*kept).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in bw.chunks(batch["text"], max_texts=CHUNK_TEXTS):
                got = votes(held.value, features(chunk))
                part = batch.slice(chunk.first, len(chunk))
                if least > 0 and not (stay := got >= least).all():
                    part, got = part.filter(pa.array(stay)), got[stay]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.array(got, pa.float64())], names=[*kept, "score"])

    scored = rows.mapInArrow(run, out)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
