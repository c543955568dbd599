"""Registered queries of the operators beyond the catalog, on whole tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from pagemill.corpus import drift, graph, held_out, integrity, lines, names, pages, sampling, vectors
from pagemill.functions import text as X
from pagemill.operators import across
from pagemill.sources.scratch import Scratch
from pagemill.streaming.monitor import Monitor

#: Neighbours of a vector, and which vectors are asked for.
NEIGHBOURS, EVERY = 10, 20
PER_SOURCE = 20
LANGUAGES = ["en", "de", "fr", "es"]


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of every twentieth vector among all, exactly."""
    scratch = Scratch(spark)
    units = scratch.save(vectors.unit_vectors(fx.table(spark, sf_dir, "embeddings")), "units")
    return vectors.exact_topk(units, F.col("vec_id") % EVERY == 0, NEIGHBOURS, scratch)


def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the index over all rows: how many queries, rows found, and whether nine of ten are right."""
    scratch = Scratch(spark)
    units = scratch.save(vectors.unit_vectors(fx.table(spark, sf_dir, "embeddings")), "units")
    asked = F.col("vec_id") % EVERY == 0
    exact = vectors.exact_topk(units, asked, NEIGHBOURS, scratch)
    found = vectors.index_topk(units, asked, NEIGHBOURS, vectors.Index(), scratch)
    of_query = vectors.recall(found, exact)
    return of_query.agg(
        F.count("*").alias("n_queries"), F.sum("n").alias("n_neighbours"), (F.sum("hits") >= 0.9 * F.sum("n")).alias("recall_reached")
    )


def resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of suppliers and customers that are one edit apart."""
    both = fx.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    both = both.union(fx.table(spark, sf_dir, "customer").select("c_name"))
    return names.similar_names(both, 1, Scratch(spark))


def dictionary_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, and how benchmark items begin (one word, two and three), in all documents."""
    begins = fx.table(spark, sf_dir, "benchmark").select("text", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    begin = F.array_join(F.slice(F.split(names.canonical(F.col("text")), " "), F.lit(1), F.col("k")), " ")
    known = fx.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).union(begins.select(begin))
    return names.dictionary_entities(fx.table(spark, sf_dir, "documents"), known, Scratch(spark))


def monitor_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events land in two parts, the first half of their time and the rest, and are counted as a stream."""
    events = fx.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    scratch = Scratch(spark)
    middle = events.agg(F.timestamp_seconds((F.min("ts").cast("long") + F.max("ts").cast("long")) / 2)).first()[0]
    watch = Monitor(spark, f"{scratch.root}/monitor")
    for part in (events.where(F.col("ts") < F.lit(middle)), events.where(~(F.col("ts") < F.lit(middle)))):
        part.write.mode("append").parquet(f"{scratch.root}/landed")
        watch.take(f"{scratch.root}/landed", events.schema)
    return watch.days()


def drift_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of the values of each kind of event, by week."""
    return drift.drift_psi(fx.table(spark, sf_dir, "events"), "event_type", "value", "ts", Scratch(spark))


def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_title(fx.table(spark, sf_dir, "pages"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.page_text(fx.table(spark, sf_dir, "pages"))
    return found.select("page_id", "n_lines", F.md5("text").alias("digest"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_links(fx.table(spark, sf_dir, "pages"))


def drop_boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of page texts that a host's pages share, and lines of documents that a language's documents share."""
    scratch = Scratch(spark)
    raw = fx.table(spark, sf_dir, "pages")
    hosts = raw.select("page_id", pages.host(F.col("url")).alias("host"))
    texts = pages.page_text(raw).select(F.col("page_id"), "text").join(hosts, "page_id")
    of_pages = lines.drop_boilerplate_lines(texts, "host", scratch, least=2, percent=30)
    documents = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    of_documents = lines.drop_boilerplate_lines(documents, "lang", Scratch(spark), least=3, percent=1)
    digest = lambda rows, kind, key: rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "n_dropped", F.md5("text").alias("digest"))
    return digest(of_pages, "page", "page_id").union(digest(of_documents, "document", "doc_id"))


def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that stand within three lines of one order: the five heaviest edges of each part."""
    return graph.top_edges(_part_edges(spark, sf_dir), 5)


def cooccurrence_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(_part_edges(spark, sf_dir))


def _part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "lineitem")
    members = rows.select(F.col("l_orderkey").alias("segment"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("node"))
    return graph.cooccurrence_edges(members, 3)


def contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents."""
    return held_out.contained_items(fx.table(spark, sf_dir, "documents"), fx.table(spark, sf_dir, "benchmark"), Scratch(spark))


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    kept = held_out.decontaminate(fx.table(spark, sf_dir, "documents"), fx.table(spark, sf_dir, "benchmark"), Scratch(spark))
    return kept.select("doc_id", F.md5("text").alias("digest"))


def balance_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fx.table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.balance(documents, "source", "doc_id", PER_SOURCE, Scratch(spark))


def domain_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.shares(fx.table(spark, sf_dir, "documents"), "source", "lang")


def corpus_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows checked and broken, by rule; of documents and of labels."""
    documents, labels = fx.table(spark, sf_dir, "documents"), fx.table(spark, sf_dir, "labels")
    summary, _ = integrity.checked(documents, integrity.document_rules(LANGUAGES), Scratch(spark))
    repeated = integrity.repeated_keys(documents, "doc_id", "repeated_id")
    return summary.union(repeated).union(integrity.orphans(labels, "doc_id", documents, "label_without_document"))


def quarantined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one language only are known here, so that many are quarantined."""
    documents = fx.table(spark, sf_dir, "documents")
    _, broken = integrity.checked(documents, integrity.document_rules(["en"]), Scratch(spark))
    return broken.select("doc_id", F.concat_ws(",", "reasons").alias("reasons"))


def _partners(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    number = lambda name: F.regexp_extract(name, "#0*([0-9]+)$", 1).cast("long").alias("number")
    suppliers, customers = fx.table(spark, sf_dir, "supplier"), fx.table(spark, sf_dir, "customer")
    return {
        "supplier": suppliers.select(
            number("s_name"), F.col("s_nationkey").alias("nation"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("balance")
        ),
        "customer": customers.select(
            number("c_name"), F.when(F.col("c_nationkey") > 4, F.col("c_nationkey")).alias("nation"), F.col("c_acctbal").alias("balance"),
            F.col("c_mktsegment").alias("segment"),
        ),
    }


def cross_source_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers of one number as one partner; suppliers are trusted more."""
    return across.cross_source_join(_partners(spark, sf_dir), "number", ["nation", "balance", "segment"])


def cross_source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return across.cross_source_merge(_partners(spark, sf_dir))


def error_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of a text, as of an error's."""
    rows = fx.table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.md5(X.first_line(F.col("text"))).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk,
        vector_index_recall,
        resolve_entities,
        dictionary_entities,
        monitor_daily,
        drift_psi,
        page_title,
        page_text,
        page_links,
        drop_boilerplate_lines,
        cooccurrence_edges,
        cooccurrence_nodes,
        contained_items,
        decontaminate,
        balance_by_source,
        domain_shares,
        corpus_checks,
        quarantined_documents,
        cross_source_join,
        cross_source_merge,
        error_first_line,
    )
}
