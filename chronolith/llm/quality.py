"""Quality by hierarchical empirical Bayes.

A document classifier gives evidence from the text alone.  Sites (hosts), and paths within them, have quality rates of their
own: beta-binomial posteriors from grouped sums of that evidence, a host's shrunk to the global rate and a path's to its
host's, by as much as the spread among sites warrants.  A document's score joins its evidence with the rate of its path among
the other documents: its own evidence is left out of the path's rate, so that it counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import broadcast_within, checkpointed, fold, text_or_empty, text_runs
from chronolith.llm.lm import tokens

#: Byte classes whose shares of a text are features.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"|%&$#*", b"@/\\_<>{}[]=+~^", bytes(range(128, 256))]
FEATURES = len(CLASSES) + 4


@dataclass
class Evidence:
    """A linear classifier over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def features(texts: pa.Array) -> np.ndarray:
    """Features of each text: shares of byte classes; length; distinct words a word; word length; repeated lines."""
    values = texts.cast(pa.binary())
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data, ends = np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    size = np.maximum(np.diff(ends), 1)
    out = np.zeros((len(texts), FEATURES))
    for n, members in enumerate(CLASSES):
        inside = np.zeros(256, bool)
        inside[list(members)] = True
        total = np.concatenate(([0], np.cumsum(inside[data], dtype=np.int64)))
        out[:, n] = (total[ends[1:]] - total[ends[:-1]]) / size
    flat, counts = tokens(texts)
    coded = flat.dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), counts)
    width = max(len(coded.dictionary), 1)
    distinct = np.bincount(np.unique(owner * width + coded.indices.to_numpy()) // width, minlength=len(texts))
    out[:, -4] = np.log1p(size)
    out[:, -3] = distinct / np.maximum(counts, 1) * np.log1p(counts) / 6
    out[:, -2] = np.log1p(size / np.maximum(counts, 1))
    lines = [t.split("\n") for t in texts.to_pylist()]
    out[:, -1] = [1 - len(set(x)) / len(x) for x in lines]
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    beta, ridge = np.zeros(a.shape[1]), np.append(np.full(x.shape[1], 1.0), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        beta -= np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * beta)
    return beta[:-1], float(beta[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 20_000) -> Evidence:
    """Fit on at most ``train_rows`` labelled rows (by hash of the id); their features, of a fixed number, reach the driver.

    Labels other than 0 and 1 and null ids don't count; of repeated labels of an id the smaller counts.
    """
    wanted = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").cast("double").alias("y"))
    wanted = wanted.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(wanted), "id").select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, "text"):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(features(batch.column(0)))), batch.column(1)], names=["x", "y"])

    held = rows.mapInArrow(run, "x array<double>, y double").toPandas()
    if not len(held):
        return Evidence(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 0.5)
    x, y = np.stack(held["x"]), held["y"].to_numpy()
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    weights, bias = fit_logistic((x - mean) / scale, y)
    return Evidence(mean, scale, weights, bias, float(np.clip(y.mean(), 0.01, 0.99)))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x))))


def _strength(sites: DataFrame, rate: str, least: float = 2.0, most: float = 1e4) -> float:
    """Prior strength, by moments: how far the rates of sites spread beyond what their sizes explain.  One row is collected."""
    error = F.col("good") / F.col("n") - F.col(rate)
    usual = F.col(rate) * (1 - F.col(rate))
    row = sites.where("n >= 2").agg(F.sum("n").alias("n"), F.sum(F.col("n") * error * error).alias("seen"), F.sum(usual).alias("noise"), F.sum(F.col("n") * usual).alias("usual")).first()
    if not row.n or not row.usual:
        return most
    between = (row.seen - row.noise) / row.usual
    return float(np.clip(1 / between - 1 if between > 0 else most, least, most))


def score(docs: DataFrame, model: Evidence, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5, broadcast_sites: int = 100_000) -> DataFrame:
    """(id, evidence, host_rate, path_rate, score, kept) of every row.

    evidence: the classifier's probability; host_rate: posterior of the row's host; path_rate: that of its path, from the
    other rows of the path.  A null host or path is one more host or path; a null text counts as empty.  Repeated rows each
    count; other columns are ignored; an empty table gives no rows.  Site tables are sums over all rows; they are broadcast
    back if they have at most ``broadcast_sites`` rows, else joined by a shuffle that AQE splits where it is skewed.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, "text"):
            if batch.num_rows:
                logit = ((features(batch.column("text")) - model.mean) / model.scale) @ model.weights + model.bias
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))], names=["id", "host", "path", "evidence"])

    judged = checkpointed(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, host string, path string, evidence double"))
    paths = checkpointed(judged.groupBy("host", "path").agg(F.sum("evidence").alias("good"), F.count(F.lit(1)).alias("n")))
    total = paths.agg(F.sum("good") / F.sum("n")).first()[0]
    overall = float(np.clip(0.5 if total is None else total, 0.01, 0.99))
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).withColumn("rate", F.lit(overall))
    weight = _strength(hosts, "rate")
    hosts = hosts.select("host", ((F.col("good") + weight * overall) / (F.col("n") + weight)).alias("host_rate"))
    paths = paths.join(broadcast_within(hosts, broadcast_sites), "host")
    weight = _strength(paths, "host_rate")
    others = (F.col("good") - F.col("evidence") + weight * F.col("host_rate")) / (F.col("n") - 1 + weight)
    found = judged.join(broadcast_within(paths.select("host", "path", "host_rate", "good", "n"), broadcast_sites), ["host", "path"]).withColumn("path_rate", others)
    bayes = _logit(F.least(F.greatest("evidence", F.lit(1e-9)), F.lit(1 - 1e-9))) - float(np.log(model.prior / (1 - model.prior)))
    scored = found.withColumn("score", _sigmoid(bayes + _logit(F.least(F.greatest("path_rate", F.lit(0.01)), F.lit(0.99)))))
    return scored.select(F.col("id").alias(id_col), "evidence", "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("kept"))


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels of the folds that may be learnt from; fold 1 of 3 is held out."""
    return labels.where(fold(id_col, 3) != 1)
