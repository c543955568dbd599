"""Quality rules whose cutoffs bound the share of good documents they reject.

Every rule compares a ratio of a text's counts with a cutoff from a fixed list, from
lenient to strict.  Labelled good documents are the holdout.  In each stratum, for each
rule, the cutoffs are tested in that order: a cutoff passes if, were its true rate of
false rejections above the rule's share of ``alpha``, so few rejections as seen would
have a probability of at most ``delta`` divided by the number of stratum-rule pairs
(exact binomial tail).  Testing in a fixed order needs no further correction, and the
rules' shares add up, so with probability 1 - delta no stratum loses more than ``alpha``
of its good documents to the rules together, whichever passing cutoffs are used.  Of
these the one is taken that rejects most labelled bad documents, less ``cost`` times the
good ones; a rule that gains nothing is left out.  All of it is DataFrame expressions.

Defined results: a NULL text has no words and fails the base rule; a NULL stratum is a
stratum by itself; a stratum without enough labels to pass any cutoff has no rule;
repeated rows are judged each, and a labelled id counts once in the holdout, by its
least label and the least of its counts; NULL labels are not used.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Scratch, text_of

WHITE = " \t\n\x0b\f\r"
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Each rule: a ratio times 100, and its cutoffs from lenient to strict; above one rejects.
RULES = {
    "symbols": ("100 * n_symbols / n_words", [300, 200, 150, 100, 75, 50, 30, 20, 10, 5]),
    "dup_lines": ("100 * n_dup_lines / n_words", [50, 30, 20, 15, 10, 7, 5, 3, 2, 1]),
    "repeats": ("100 * n_repeat_words / n_words", [50, 45, 40, 35, 30, 25, 20, 15, 10, 5]),
    "long_words": ("100 * word_chars / n_words", [3000, 2000, 1500, 1200, 1100, 1000, 900, 800, 700, 600]),
    "short_words": ("-100 * word_chars / n_words", [-100, -150, -200, -250, -300, -350, -400, -450, -500, -550]),
}


@dataclass(frozen=True)
class Risk:
    """At most ``alpha`` of the good documents of a stratum, with confidence 1 - ``delta``."""

    alpha: float = 0.02
    delta: float = 0.05
    cost: float = 20.0
    stratum: str = "lang"


def with_counts(documents: DataFrame) -> DataFrame:
    """``documents`` with COUNTS over the whole text; each costly step is its own projection.

    Windows of three words are compared by 64-bit hashes.
    """
    text = text_of()
    rows = documents.withColumn("_words", F.array_remove(F.split(text, SPACES), ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(WHITE)) != "")
    rows = rows.withColumn("_lines", lines).withColumn("n_words", F.size("_words").cast("long"))
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    rows = rows.withColumn("word_chars", F.char_length(F.concat_ws("", "_words")).cast("long"))
    rows = rows.withColumn("n_symbols", (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"))
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words")
    rest = lambda k: F.slice("_hashes", k, F.greatest(F.size("_hashes") - 2, F.lit(0)))
    pairs = F.zip_with(rest(1), rest(2), lambda a, b: F.xxhash64(a, b))
    rows = rows.withColumn("_windows", F.zip_with(pairs, rest(3), lambda a, b: F.xxhash64(a, b))).drop("_hashes")
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.sort_array(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    rows = rows.withColumn("_sorted", F.when(again, placed)).drop("_windows")
    # Neighbours of the sorted windows that are equal: both are repeated.
    after = F.slice("_sorted", F.lit(2), F.greatest(F.size("_sorted") - 1, F.lit(0)))
    equal = F.zip_with("_sorted", after, lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
    rows = rows.withColumn("_pairs", F.filter(equal, lambda x: x.isNotNull())).drop("_sorted")
    places = F.transform(F.array_distinct(F.flatten("_pairs")), lambda i: F.array(i, i + 1, i + 2))
    rows = rows.withColumn("_covered", F.array_distinct(F.flatten(places))).drop("_pairs")
    return rows.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_covered").isNotNull(), F.size("_covered")), F.lit(0)).cast("long")).drop("_covered")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def log_gamma(x: Column) -> Column:
    """Stirling's series after a shift by 8; x > 0, error below 1e-11."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    shift = F.log(x)
    for k in range(1, 8):
        shift = shift + F.log(x + k)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p) where k < n p; 1 elsewhere.

    The terms fall geometrically from k down; those beyond 100,000 are bounded by their series.
    """
    top = (
        log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) + k * math.log(p) + (n - k) * math.log(1 - p)
    )  # log P(X = k)
    ratio = lambda j: j / (n - j + 1.0) * ((1 - p) / p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    steps = F.when(k > 0, F.sequence(k.cast("int"), F.greatest(k - 99_999, F.lit(1)).cast("int"), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    summed = F.aggregate(
        steps, start, lambda s, j: F.struct((s["term"] * ratio(j)).alias("term"), (s["total"] + s["term"] * ratio(j)).alias("total"))
    )
    last = F.greatest(k - 100_000, F.lit(0))
    rest = F.when(last > 0, summed["term"] * ratio(last) / (1 - ratio(last))).otherwise(0.0)
    return F.when(k < n * p, F.least(F.lit(1.0), F.exp(top) * (summed["total"] + rest))).otherwise(1.0)


def holdout(rows: DataFrame, labels: DataFrame, risk: Risk) -> DataFrame:
    """(stratum, good, COUNTS): one row for each labelled document that passes the base rule."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    found = rows.where(~base_failed()).select("doc_id", risk.stratum, *COUNTS).join(known, "doc_id")
    least = [F.min(c).alias(c) for c in ("good", *COUNTS)]
    return found.groupBy("doc_id").agg(F.min(risk.stratum).alias("stratum"), *least)


def cutoffs(found: DataFrame, risk: Risk) -> DataFrame:
    """(stratum, a column for each rule): the chosen cutoffs, NULL where there is none."""
    rejects = lambda ratio, c, good: F.sum(((F.expr(ratio) > c) & (F.col("good") == good)).cast("long"))
    tests = [
        F.struct(F.lit(rule).alias("rule"), F.lit(float(c)).alias("cutoff"), rejects(ratio, c, True).alias("k"), rejects(ratio, c, False).alias("hits"))
        for rule, (ratio, strictness) in RULES.items()
        for c in strictness
    ]
    sizes = [F.count_if("good").alias("n"), F.count_if(~F.col("good")).alias("bad")]
    counted = found.groupBy("stratum").agg(*sizes, F.array(*tests).alias("tests")).where("n > 0")
    strata = found.where("good").select("stratum").distinct().count()
    tested = counted.select("stratum", "n", "bad", F.explode("tests").alias("t")).select("stratum", "n", "bad", "t.*")
    passed = binomial_tail(F.col("n"), F.col("k"), risk.alpha / len(RULES)) <= risk.delta / (max(strata, 1) * len(RULES))
    gain = F.when(F.col("bad") > 0, F.col("hits") / F.col("bad") - risk.cost * (F.col("k") / F.col("n"))).otherwise(0.0)
    tested = tested.withColumn("gain", F.when(passed & (gain > 0), gain))
    order = F.when(F.col("gain").isNotNull(), F.struct("gain", "cutoff"))
    best = [F.max_by("cutoff", F.when(F.col("rule") == rule, order)).alias(rule) for rule in RULES]
    return tested.groupBy("stratum").agg(*best)


def judge(rows: DataFrame, found: DataFrame, risk: Risk) -> DataFrame:
    """``rows`` with ``base_failed`` and ``kept``."""
    limits = found.select(F.col("stratum").alias("_stratum"), *(F.col(r).alias(f"_{r}") for r in RULES))
    joined = rows.join(limits, F.col(risk.stratum).eqNullSafe(F.col("_stratum")), "left")
    rejected = F.lit(False)
    for rule, (ratio, _) in RULES.items():
        rejected = rejected | F.coalesce(F.expr(ratio) > F.col(f"_{rule}"), F.lit(False))
    judged = joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)
    return judged.select(*rows.columns, "base_failed", "kept")


def quality_rules(documents: DataFrame, labels: DataFrame, risk: Risk | None = None) -> DataFrame:
    """(doc_id, stratum, COUNTS, base_failed, kept) of every row."""
    risk, scratch = risk or Risk(), Scratch(documents.sparkSession)
    rows = scratch.save(with_counts(documents).select("doc_id", risk.stratum, *COUNTS), "counts")
    held = scratch.save(holdout(rows, labels, risk), "holdout")
    # A few numbers for each stratum; written, so that the planner knows their size.
    found = scratch.save(cutoffs(held, risk), "cutoffs")
    scratch.drop("holdout")
    return judge(rows, found, risk)
