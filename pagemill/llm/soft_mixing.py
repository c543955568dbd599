"""Mix documents to target weights of domains that a classifier predicts softly.

A naive Bayes model over hashed words (runs of letters and digits, by presence) learns from
labelled documents and gives every document a posterior over the domains; its
temperature is the one of a fixed list with the least log loss on a fourth of the
sample that the weights tried there have not seen.  Non-negative rates, one per
document, then bring the expected words of each domain as close as possible (least
squares) to its target: projected gradient steps, each one aggregation of the domains'
totals over the cluster.  A rate is a function of the posterior and the steps so far,
so no rate is stored or joined between the steps.  What stays off the targets is in
``Model.residual``; an end at ``max_steps`` also warns.  All of it is DataFrame
expressions; the driver holds a weight per bucket and domain, and one number per domain
and step.

Defined results: NULL, blank and wordless texts have no words, the prior as posterior
and weigh nothing; words of marks only count but tell nothing.  Labels that are NULL
or no target teach nothing; a target without labelled documents gets almost no
posterior, and the rates are the least squares solution that remains.  Repeated rows
are documents of their own.
"""

import math
import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Scratch, text_of

SPACES = "[\\x20\\x09-\\x0D]+"
MARKS = "[^\\p{L}\\p{N}]+"
TEMPERATURES = (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 32.0)


@dataclass(frozen=True)
class Settings:
    """``sample`` labelled documents at most are learned from, an equal part of each domain at most."""

    sample: int = 8192
    buckets: int = 4096
    temperature: float = 2.0  # where no text is left to choose it by
    tolerance: float = 1e-6
    max_steps: int = 200


@dataclass
class Model:
    domains: list[str]
    prior: list[float]  # log
    weights: list[list[float]]  # by domain and bucket: log share of the documents that hold it
    temperature: float = 1.0
    residual: list[float] = field(default_factory=list)  # by domain: expected words less the target


def hashed_words(buckets: int, column: str = "text") -> Column:
    """The different buckets of the different runs of letters and digits of the whole text."""
    words = F.array_remove(F.array_distinct(F.split(F.lower(text_of(column)), MARKS)), "")
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")))


def weights_of(counts: list[list[int]], sizes: list[int]) -> list[list[float]]:
    """Smoothed log shares, to six places."""
    return [[round(math.log((c + 0.5) / (n + 1.0)), 6) for c in row] for row, n in zip(counts, sizes, strict=True)]


def evidence(model: Model) -> Column:
    """By domain: the sum of the weights of the buckets in ``_hashed``."""

    def total(weights: list[float]) -> Column:
        table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")  # the optimizer makes it one literal
        return F.aggregate("_hashed", F.lit(0.0), lambda a, b: a + F.get(table, b))

    return F.array(*map(total, model.weights))


def with_softmax(rows: DataFrame, prior: list[float], temperature: Column) -> DataFrame:
    """``rows`` with ``_p`` in place of ``_e``: prior and cooled evidence, by domain; each step is its own projection."""
    logits = F.zip_with("_e", F.array(*map(F.lit, prior)), lambda x, p: x / temperature + p)
    rows = rows.withColumn("_e", logits).withColumn("_top", F.array_max("_e"))
    rows = rows.withColumn("_e", F.transform("_e", lambda x: F.exp(x - F.col("_top"))))
    rows = rows.withColumn("_top", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
    return rows.withColumn("_p", F.transform("_e", lambda x: x / F.col("_top"))).drop("_e", "_top")


def draw(known: DataFrame, domains: list[str], sample: int) -> DataFrame:
    """At most an equal part of ``sample`` from each domain, by the hash of the id."""
    part = max(sample // max(len(domains), 1), 1)
    parts = [known.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(part) for d in domains]
    return reduce(DataFrame.unionByName, parts)


def fit(documents: DataFrame, labelled: DataFrame, domains: list[str], settings: Settings | None = None, scratch: Scratch | None = None) -> Model:
    """Learn from ``labelled`` (doc_id, domain): shares of the buckets in a bounded sample, the prior of all labels."""
    settings, domains = settings or Settings(), sorted(domains)
    scratch = scratch or Scratch(documents.sparkSession)
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
    known = scratch.save(known.groupBy("doc_id").agg(F.min("domain").alias("domain")), "labelled")
    labels = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    total = sum(labels.values()) + len(domains)
    prior = [math.log((labels.get(d, 0) + 1) / total) for d in domains]
    texts = documents.select("doc_id", "text").join(F.broadcast(draw(known, domains, settings.sample)), "doc_id")
    texts = texts.groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
    tried = F.pmod(F.xxhash64("doc_id", F.lit("tried")), F.lit(4)) == 0
    texts = texts.select("domain", tried.alias("tried"), hashed_words(settings.buckets).alias("_hashed"))
    texts = scratch.save(texts.where(F.size("_hashed") > 0), "sample")
    sizes = {(r["domain"], r["tried"]): r["count"] for r in texts.groupBy("domain", "tried").count().collect()}
    seen = texts.select("domain", "tried", F.explode("_hashed").alias("bucket")).groupBy("bucket", "domain", "tried").count()
    counts = {part: [[0] * settings.buckets for _ in domains] for part in (False, True)}
    for row in seen.collect():  # a number for each bucket, domain and part at most
        counts[row["tried"]][domains.index(row["domain"])][row["bucket"]] = row["count"]
    first = Model(domains, prior, weights_of(counts[False], [sizes.get((d, False), 0) for d in domains]))
    both = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(counts[False], counts[True], strict=True)]
    model = Model(domains, prior, weights_of(both, [sizes.get((d, False), 0) + sizes.get((d, True), 0) for d in domains]))
    model.temperature = calibrated(texts.where("tried"), first, settings.temperature)
    for name in ("labelled", "sample"):
        scratch.drop(name)
    return model


def calibrated(texts: DataFrame, model: Model, default: float) -> float:
    """The temperature with the least log loss on ``texts`` (domain, _hashed), the lower of two."""
    tried = texts.select("domain", evidence(model).alias("_e"), F.explode(F.array(*map(F.lit, TEMPERATURES))).alias("_t"))
    own = F.array_position(F.array(*map(F.lit, model.domains)), F.col("domain")).cast("int") - 1
    loss = -F.log(F.greatest(F.get("_p", own), F.lit(1e-300)))
    losses = with_softmax(tried, model.prior, F.col("_t")).groupBy("_t").agg(F.sum(loss).alias("loss")).collect()
    return min(((r["loss"], r["_t"]) for r in losses), default=(0.0, default))[1]


def with_posteriors(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with ``_n`` words and ``_p``, the posterior of each domain in order."""
    words = F.array_remove(F.split(text_of(), SPACES), "")
    rows = documents.withColumn("_n", F.size(words).cast("long")).withColumn("_hashed", hashed_words(len(model.weights[0])))
    rows = rows.withColumn("_e", evidence(model)).drop("_hashed")
    return with_softmax(rows, model.prior, F.lit(model.temperature))


def rate(steps: list[list[float]]) -> Column:
    """The rate after the steps: each moves it along the posterior and back to 0 at least."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*(F.array(*map(F.lit, g)) for g in steps))
    along = lambda g: F.aggregate(F.zip_with("_p", g, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(moves, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - along(g)))


def expected(rows: DataFrame, model: Model) -> list[float]:
    """Expected words of each domain at rate 1."""
    sums = [F.sum(F.col("_n") * F.col("_p")[i]) for i in range(len(model.domains))]
    return [x or 0.0 for x in rows.agg(*sums).first()]


def fit_rates(rows: DataFrame, targets: list[float], settings: Settings | None = None) -> list[list[float]]:
    """Steps whose ``rate`` makes sum(_n * _p * rate) the least squares fit to ``targets``.

    ``rows`` has ``_n`` and ``_p``.  A step is scaled by the second moments of the
    posteriors, bounded so that the residual cannot grow.
    """
    settings, k = settings or Settings(), len(targets)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moments = rows.agg(*(F.sum(F.col("_n") * F.col("_p")[i] * F.col("_p")[j]) for i, j in pairs)).first()
    m = {}
    for (i, j), x in zip(pairs, moments, strict=True):
        m[i, j] = m[j, i] = x or 0.0
    scale = [max(m[i, i], 1e-12) for i in range(k)]
    reach = max(sum(m[i, j] / math.sqrt(scale[i] * scale[j]) for j in range(k)) for i in range(k))
    steps: list[list[float]] = []
    size, before = sum(targets) or 1.0, math.inf
    while len(steps) < settings.max_steps:
        now = rows.select("_n", "_p", rate(steps).alias("_r"))
        got = now.agg(*(F.sum(F.col("_n") * F.col("_r") * F.col("_p")[i]) for i in range(k))).first()
        off = [(x or 0.0) - t for x, t in zip(got, targets, strict=True)]
        error = sum(x * x / s for x, s in zip(off, scale, strict=True))
        if max(map(abs, off)) <= settings.tolerance * size or before - error <= 1e-9 * error:
            break
        before = error
        steps.append([x / s / max(reach, 1.0) for x, s in zip(off, scale, strict=True)])
    else:
        warnings.warn(f"rates not settled after {settings.max_steps} steps: words off the targets {off}", stacklevel=2)
    return steps


def targets_of(totals: list[float], weights: dict[str, float], domains: list[str], keep_all: bool) -> list[float]:
    """Words that each domain should have.

    The total is that of the documents, or, to ``keep_all``, the least with which no
    domain has to give up words, so that documents are repeated and none is dropped.
    """
    weight = [weights[d] / sum(weights.values()) for d in domains]
    total = sum(totals)
    if keep_all:
        total = max((t / w for t, w in zip(totals, weight, strict=True) if w > 0), default=0.0)
    return [w * total for w in weight]


def copies(key: Column, least: int = 0) -> Column:
    """Whole copies of a document, ``least`` or more, whose mean over documents is the rate."""
    spread = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return F.greatest(F.lit(least), F.floor(F.col("_rate") + spread).cast("int"))


def mix(
    documents: DataFrame, labelled: DataFrame, weights: dict[str, float], keep_all: bool = False, settings: Settings | None = None
) -> tuple[DataFrame, Model]:
    """``documents`` with ``_n``, ``_p``, ``_rate`` and ``_copies``; columns of these names are replaced."""
    return mixed_columns(documents, labelled, weights, documents.columns, keep_all, settings)


def mixed_columns(
    documents: DataFrame,
    labelled: DataFrame,
    weights: dict[str, float],
    keep: list[str],
    keep_all: bool = False,
    settings: Settings | None = None,
) -> tuple[DataFrame, Model]:
    """As ``mix``, with the columns ``keep`` only; the texts are read once to weigh them."""
    scratch = Scratch(documents.sparkSession)
    new = ("_n", "_p", "_rate", "_copies", "_hashed", "_e", "_top")
    documents = documents.drop(*new)
    model = fit(documents, labelled, list(weights), settings, scratch)
    kept = [c for c in keep if c not in new]
    rows = scratch.save(with_posteriors(documents, model).select(*kept, "_n", "_p"), "posteriors")
    narrow = rows.select("_n", "_p")
    targets = targets_of(expected(narrow, model), weights, model.domains, keep_all)
    steps = fit_rates(narrow, targets, settings)
    reached = expected(narrow.withColumn("_n", F.col("_n") * rate(steps)), model)
    model.residual = [x - t for x, t in zip(reached, targets, strict=True)]
    rows = rows.withColumn("_rate", rate(steps))
    return rows.withColumn("_copies", copies(F.col("doc_id"), int(keep_all))), model
