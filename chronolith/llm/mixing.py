"""Mixing sources to target weights, with soft membership.

A naive Bayes classifier over hashed words, learnt from a table of labelled rows, predicts each document's posterior over
domains.  Projected-gradient least squares then fits a rate for each document, between 0 and ``max_rate``, so that the expected
tokens of each domain (rate x tokens x posterior, summed) meet their targets; rates stay as near to 1 as that allows.  All of
it is DataFrame expressions: a step of the gradient is one aggregate over the table of posteriors, of a few numbers each.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import ascii_lower, checkpointed, text_or_empty

BUCKETS = 1 << 16
LOG = logging.getLogger(__name__)


def _words(rows: DataFrame, *keys: str) -> DataFrame:
    """(*keys, bucket): a row for each word of ``text``; one with a null bucket for a text without words."""
    words = F.split(ascii_lower(F.col("text")), r"[\x20\x09-\x0D]+")
    exploded = rows.select(*keys, F.explode_outer(F.array_remove(words, "")).alias("word"))
    return exploded.select(*keys, F.when(F.col("word").isNotNull(), F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")).alias("bucket"))


def posteriors(
    docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text",
    train_rows: int = 20_000, shrink: float = 4.0, reach: float = 100.0,
) -> DataFrame:
    """(id, tokens, p array<double>): words of each row's whole text, and its posterior over ``domains`` in their order.

    ``labelled``: id and domain; at most ``train_rows`` rows (by hash of the id) that ``docs`` holds are learnt from; other
    domains and null ids don't count.  A word weighs by the log of its share in a domain over its share in all, shrunk by
    ``shrink`` occurrences; long texts count as ``reach`` words, so membership stays soft.  The weights, of a fixed number
    of hash buckets, are broadcast.  A text without words, or any text where nothing could be learnt, gets the prior.
    """
    known = labelled.where(F.col("domain").isin(domains) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("domain").alias("domain"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    counted = _words(rows.join(F.broadcast(known), "id"), "domain").where("bucket IS NOT NULL")
    inside = [F.sum(F.when(F.col("domain") == d, 1.0).otherwise(0.0)).alias(f"n{k}") for k, d in enumerate(domains)]
    table = checkpointed(counted.groupBy("bucket").agg(*inside))
    sums = table.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0.0)).alias(f"n{k}") for k in range(len(domains))]).first()
    seen = dict(known.groupBy("domain").count().collect())
    prior = [(seen.get(d, 0) + 1.0) / (sum(seen.values()) + len(domains)) for d in domains]
    share = sum(F.col(f"n{k}") for k in range(len(domains))) / max(sum(sums), 1.0)
    weights = table.select("bucket", *[F.log((F.col(f"n{k}") + shrink * share) / (sums[k] + shrink) / share).alias(f"w{k}") for k in range(len(domains))])
    each = _words(rows.withColumn("row", F.monotonically_increasing_id()), "row", "id").join(F.broadcast(weights), "bucket", "left")
    scored = each.groupBy("row", "id").agg(F.count("bucket").alias("tokens"), *[F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(len(domains))])
    soft = F.least(F.lit(1.0), reach / F.greatest(F.col("tokens"), F.lit(1)))
    logits = F.array(*[F.col(f"s{k}") * soft + math.log(prior[k]) for k in range(len(domains))])
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return scored.select("id", "tokens", F.transform(powers, lambda x: x / total).alias("p"))


def _expected(table: DataFrame, rate: Column, domains: int) -> list[float]:
    rated = table.select("tokens", "p", rate.alias("rate"))
    row = rated.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col("p")[k] * F.col("rate")), F.lit(0.0)) for k in range(domains)]).first()
    return [float(x) for x in row]


def fit_rates(table: DataFrame, targets: list[float], max_rate: float = 4.0, pull: float = 1e-4, tolerance: float = 1e-4, steps: int = 40) -> Column:
    """The rate of a row of ``table`` (tokens, p) as an expression of p.

    Minimises the squares of (expected - target) tokens of each domain, weighed by the domain's present tokens, plus ``pull``
    times the token-weighted squares of (rate - 1), for rates in [0, ``max_rate``].  The step is scaled by each row's tokens,
    which keeps the projection exact; its length 1 / (1 + pull) is safe, as the weighed normal matrix has no eigenvalue over
    1.  Stops when every domain is within ``tolerance`` of all tokens, or after ``steps``; each step is one aggregate.
    The expression folds the steps' factors, given as an array: unrolled, it would grow, and every step would compile code of
    its own on the driver and the executors.
    Targets that are missed by more (rates may not reach them, or the pull holds them back) are logged with what is left.
    """
    k = len(targets)
    present = _expected(table, F.lit(1.0), k)
    total = sum(present) or 1.0
    weight = [max(x / total, 1e-6) for x in present]
    rate, length, factors = F.lit(1.0), 1.0 / (1.0 + pull), []

    def moved(rate: Column, factor: Column) -> Column:
        slope = sum(F.col("p")[n] * factor[n] for n in range(k))
        return F.greatest(F.lit(0.0), F.least(F.lit(float(max_rate)), rate * (1.0 - length * pull) - length * (slope - pull)))

    for step in range(steps + 1):
        off = [(e - t) / total for e, t in zip(_expected(table, rate, k), targets, strict=True)]
        if max(map(abs, off)) <= tolerance:
            break
        if step == steps:
            LOG.warning("targets are missed by %s of all tokens after %d steps", [round(x, 6) for x in off], steps)
            break
        factors.append([float(o / w) for o, w in zip(off, weight, strict=True)])
        rate = F.aggregate(F.lit(factors), F.lit(1.0), moved)
    return rate


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], size: float = 1.0, max_rate: float = 4.0, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """(id, tokens, one p_<domain> each, rate, copies) of every row.

    ``weights``: each domain's share of the mix (scaled to sum 1), ``size`` times the present tokens in all.  copies: the
    rate rounded up or down at random, by a hash of the id, so that its mean is the rate.  Null texts count as empty; null
    ids and repeated rows are rows like others; an empty table gives no rows; other columns are ignored.
    """
    domains = sorted(weights)
    table = checkpointed(posteriors(docs, labelled, domains, id_col, text_col))
    tokens = table.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    targets = [weights[d] / sum(weights.values()) * tokens * size for d in domains]
    rated = table.withColumn("rate", fit_rates(table, targets, max_rate))
    chance = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return rated.select(F.col("id").alias(id_col), "tokens", *[F.col("p")[n].alias(f"p_{d}") for n, d in enumerate(domains)], "rate", F.floor(F.col("rate") + chance).cast("int").alias("copies"))


def apply_mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], size: float = 1.0, max_rate: float = 4.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, each row as many times as :func:`mix` says (of rows that repeat an id, the most)."""
    copies = mix(docs, labelled, weights, size, max_rate, id_col, text_col).groupBy(F.col(id_col).alias("__id")).agg(F.max("copies").alias("__copies"))
    joined = docs.join(copies, F.col(id_col).eqNullSafe(F.col("__id"))).where("__copies > 0")
    return joined.withColumn("__copies", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains of a table of labels (quality, toxic): toxic, else clean or rough by quality."""
    return labels.withColumn("domain", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "rough"))
