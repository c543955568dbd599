"""Rules that rows must keep: counted and quarantined in one pass."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pagemill.functions.text import strip
from pagemill.sources.scratch import Scratch


def document_rules(languages: list[str]) -> dict[str, Column]:
    """Name -> what breaks the rule, on rows of ``documents``; a NULL condition breaks nothing."""
    return {
        "no_id": F.col("doc_id").isNull(),
        "no_text": F.col("text").isNull(),
        "blank_text": strip(F.col("text")) == "",
        "wrong_length": F.col("n_chars") != F.char_length("text"),
        "unknown_language": ~F.coalesce(F.col("lang"), F.lit("")).isin(languages),
        "control_signs": F.rlike("text", F.lit("[\\x00-\\x08\\x0E-\\x1F\\x7F]")),
        "replaced_signs": F.contains("text", F.lit("�")),
    }


def judged(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with ``reasons``: the names of the rules that a row breaks, in the order of ``rules``."""
    found = F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items()))
    return rows.withColumn("reasons", F.array_compact(found))


def checked(rows: DataFrame, rules: dict[str, Column], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(summary, quarantined): rows checked and broken by rule, and the rows that break one, with reasons.

    The rows are read once: the counts are observed while the broken rows are written.
    """
    seen = Observation()
    counts = [F.count_if(F.array_contains("reasons", name)).alias(name) for name in rules]
    watched = judged(rows, rules).observe(seen, F.count("*").alias("*rows"), *counts)
    quarantined = scratch.save(watched.where(F.size("reasons") > 0), "quarantined")
    found = seen.get
    summary = [(name, found["*rows"], found[name]) for name in rules]
    return rows.sparkSession.createDataFrame(summary, "rule string, checked long, broken long"), quarantined


def repeated_keys(rows: DataFrame, key: str, rule: str) -> DataFrame:
    """(rule, checked, broken): rows whose key another row has, too; a missing key repeats nothing."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    broken = F.sum(F.when(F.col(key).isNotNull() & (F.col("n") > 1), F.col("n")).otherwise(0))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked"), F.coalesce(broken, F.lit(0)).alias("broken")).select(
        F.lit(rule).alias("rule"), "checked", "broken"
    )


def orphans(rows: DataFrame, key: str, of: DataFrame, rule: str) -> DataFrame:
    """(rule, checked, broken): rows whose key is missing or in no row of ``of``."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    known = of.select(F.col(key).alias("_known")).where("_known is not null").distinct()
    met = counts.join(known, F.col(key) == F.col("_known"), "left")
    broken = F.sum(F.when(F.col("_known").isNull(), F.col("n")).otherwise(0))
    return met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked"), F.coalesce(broken, F.lit(0)).alias("broken")).select(
        F.lit(rule).alias("rule"), "checked", "broken"
    )
