"""What a task holds at once is bounded in bytes: texts, results on their way back, rows before they are written."""

import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pagemill.llm import bytewords as bw
from pagemill.llm import common, neighbour_vote, phrase_mining
from pagemill.llm.common import Scratch, prepare

# --- pipeline: texts are read and scored in small parts


def test_scan_decodes_few_rows_at_once(spark):
    spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
    prepare(spark)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) == common.SCAN_ROWS <= 256


def test_chunks_bound_the_number_of_texts():
    texts = pa.array([f"a{i}" if i % 7 else None for i in range(5000)])
    (whole,) = bw.chunks(texts)
    parts = list(bw.chunks(texts, max_texts=300))
    assert max(map(len, parts)) == 300 and [c.first for c in parts] == list(range(0, 5000, 300))
    assert np.array_equal(np.concatenate([c.word_hashes() for c in parts]), whole.word_hashes())


def test_features_of_many_short_texts_are_made_in_parts(spark, monkeypatch):
    most, made = neighbour_vote.CHUNK_TEXTS, neighbour_vote.features

    def bounded(chunk):
        assert len(chunk) <= most
        return made(chunk)

    monkeypatch.setattr(neighbour_vote, "features", bounded)
    docs = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = neighbour_vote.fit(docs, labels)
    assert neighbour_vote.score(docs, model).count() == 5000


# --- op12_collocations: results and tables in small parts


def test_results_come_back_in_bounded_batches():
    n = 600_000
    keys = np.arange(n, dtype=np.int64)
    words = pa.array([f"word-{k}" for k in range(n)])
    batches = list(phrase_mining._rows(n, kind=np.ones(n, np.int32), key=keys, n=keys, word=words))
    assert max(b.nbytes for b in batches) <= 1.1 * common.BATCH_BYTES
    table = pa.Table.from_batches(batches)
    assert table["key"].to_pylist() == keys.tolist() and table["word"].combine_chunks().equals(words)
    wide = pa.schema([("x", pa.string())])
    assert [len(b) for b in common.batches_of({"x": ["y" * common.BATCH_BYTES, "z" * common.BATCH_BYTES]}, wide)] == [1, 1]
    assert not list(common.batches_of({"x": []}, wide))


def test_scratch_tables_have_small_row_groups(spark):
    scratch = Scratch(spark)
    ids = spark.range(0, 4_000_000, 1, 1).select(F.xxhash64("id").alias("x"))
    saved = scratch.save(ids, "ids")
    assert saved.count() == 4_000_000
    (path,) = glob.glob(scratch.path("ids").removeprefix("file://").removeprefix("file:") + "/*.parquet")
    meta = pq.ParquetFile(path).metadata
    sizes = [meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)]
    assert max(sizes) <= 1.5 * common.ROW_GROUP_BYTES and len(sizes) >= 3
