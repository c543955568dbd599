"""The registered queries of the training-data operators."""

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import (
    cover_tree,
    extendible_shards,
    jaccard_join,
    neighbour_vote,
    periodic_runs,
    phrase_mining,
    piece_transducer,
    risk_rules,
    segment_search,
    soft_mixing,
    suffix_dedup,
    token_frames,
    tool_chat,
)
from pagemill.llm.common import WORD, Scratch, prepare, table


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; ``TOKENIZER_DIR`` names another folder than that of the installed package."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = risk_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *risk_rules.COUNTS, "base_failed", "kept")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = piece_transducer.read_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    return piece_transducer.encode(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"])


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    documents = suffix_dedup.keyed(table(spark, sf_dir, "documents"), scratch)
    found = suffix_dedup.spans(documents, scratch=scratch)
    words = lambda spans: F.aggregate(spans, F.lit(0), lambda n, s: n + s["end"] - s["start"])
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])))
    return suffix_dedup.same_doc(documents.select("doc_id", "_key"), found, "left").select(
        "doc_id",
        F.coalesce(words("repeated"), F.lit(0)).alias("n_repeated_words"),
        F.coalesce(words("later"), F.lit(0)).alias("n_cut_words"),
        text("repeated").alias("repeated_spans"),
        text("later").alias("cut_spans"),
    )


#: What the questions of ``op4_chat_formatting`` call.
TOOLS = {"answer": tool_chat.Tool({"chars": "integer", "text": "string"}, ("text",))}


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn is a call that follows the user turn before it; an assistant turn is the result."""
    turns = table(spark, sf_dir, "conversations")
    name = lambda back: F.concat_ws("-", "conv_id", F.col("turn") - back)
    none = F.array().cast("array<string>")
    call = F.struct(
        F.when(F.col("turn") >= 2, F.array(name(2))).otherwise(none).alias("after"),
        F.struct(F.char_length("text").alias("chars"), "text").alias("arguments"),
        name(0).alias("id"),
        F.lit("answer").alias("name"),
    )
    asked = F.to_json(F.struct(F.array(call).alias("tool_calls")))
    answered = F.to_json(F.struct(F.col("text").alias("content"), name(1).alias("tool_call_id")))
    messages = turns.select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"),
        F.when(F.col("role") == "user", asked).when(F.col("role") == "assistant", answered).otherwise(F.col("text")).alias("text"),
    )
    return tool_chat.format_chat(messages, TOOLS)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = neighbour_vote.fit(documents, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return neighbour_vote.score(documents, model, keep=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted"
    )


def op7_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path("byte_bpe_50k.json")) as file:
        definition = file.read()
    path = Scratch(spark).path("tokens")
    token_frames.write(table(spark, sf_dir, "documents"), definition, path)
    return token_frames.read_digests(spark, path)


#: Shares of the words of a training mix.
MIX = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labelled = documents.select("doc_id", F.col("lang").alias("domain")).join(
        table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"
    )
    mixed, model = soft_mixing.mixed_columns(documents, labelled, MIX, ["doc_id"])
    return mixed.select(
        "doc_id",
        F.col("_n").alias("n_words"),
        *(F.col("_p")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)),
        F.col("_rate").alias("rate"),
        F.col("_copies").alias("copies"),
    )


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards.shards(table(spark, sf_dir, "documents"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))


def looped(documents: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by the hash of the id, goes in circles from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = documents.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    some = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    some = some.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int")))
    return some.select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", again)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(looped(table(spark, sf_dir, "documents")), keep=["doc_id"])
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    best = found.withColumn("best", periodic_runs.longest())
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    query.__name__: _shipped(query)
    for query in (
        op1_quality_rules,
        op2_sentencepiece,
        op3_suffix_array_dedup,
        op4_chat_formatting,
        op5_ngram_jaccard_join,
        op6_quality_classifier,
        op7_token_frames,
        op8_mixing,
        op9_embedding_near_dedup,
        op10_sharding,
        op11_exact_topk,
        op12_collocations,
        op13_periodic_runs,
    )
}
