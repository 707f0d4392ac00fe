"""Toxicity by weak supervision.

Voters are fixed lexicons, fixed patterns (word beginnings, several lexicon words in one text), and terms (words and
beginnings) that the training labels tie to toxicity.  A generative label model, fitted by expectation maximisation on their
votes, estimates each voter's accuracy and the correlations among voters, and gives each training text a posterior label;
the given labels are a prior of the voters' rates, they are no voter.  A linear classifier over all terms is trained on those posteriors and
scores every text.  Training reads a bounded sample of labelled rows; scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import checkpointed, fold, hand_back, text_or_empty, text_runs
from chronolith.llm.simhash import shingle_hashes

#: Kinds of terms: whole words (0), or beginnings of so many characters.
KINDS = (0, 4, 5, 6)
#: Lexicon voters.
LEXICONS = {
    "insults": "idiot moron stupid dumb fool imbecile loser clown jerk dimwit halfwit nitwit dunce buffoon simpleton twit dolt coward freak".split(),
    "contempt": "pathetic worthless disgusting trash scum garbage filth vermin useless vile repulsive despicable parasite lowlife degenerate inferior".split(),
    "hostility": "hate kill die hurt destroy crush rot suffer attack threaten".split(),
    "profanity": "damn crap bastard bitch shit fuck piss bollocks".split(),
}
#: Pattern voters: beginnings of so many letters of the words of these lexicons, and so many lexicon words in one text.
BEGINNING, BEGUN, SEVERAL = 5, ("insults", "contempt"), 3
EDGES = ".,;:!?\"'()[]{}<>|%&$#*-_/\\~`^+="


@dataclass
class Toxicity:
    """terms: for each kind, the terms in order; weights: of all terms in that order; bias; of the sample, posteriors and labels."""

    terms: dict[int, list[str]]
    weights: np.ndarray
    bias: float
    posterior: np.ndarray = field(default_factory=lambda: np.empty(0))
    given: np.ndarray = field(default_factory=lambda: np.empty(0))


def term_columns(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, pa.Array]]:
    """Owner and word code of each word of a batch in turn, and each kind's term of every distinct word (null: none)."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    words = pc.utf8_trim(coded.dictionary, EDGES)
    length = pc.utf8_length(words)
    terms = {k: pc.if_else(pc.greater_equal(length, max(k, 1)), pc.utf8_slice_codeunits(words, 0, k) if k else words, pa.scalar(None, pa.string())) for k in KINDS}
    return owner, coded.indices.to_numpy(), terms


def count_terms(labelled: DataFrame) -> DataFrame:
    """(kind, term, toxic, clean): texts of each label with the term; ``labelled`` is (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, "text"):
            owner, codes, terms = term_columns(batch.column(0))
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for kind, values in terms.items():
                coded = values.dictionary_encode()
                at = coded.indices.fill_null(-1).to_numpy()[codes] if len(codes) else np.empty(0, np.int64)
                size = max(len(coded.dictionary), 1)
                pairs = np.unique(owner[at >= 0] * size + at[at >= 0])
                toxic = label[pairs // size] == 1
                n = [np.bincount(pairs[m] % size, minlength=size)[: len(coded.dictionary)] for m in (toxic, ~toxic)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(coded.dictionary), kind, np.int32)), coded.dictionary, *map(pa.array, n)], names=["kind", "term", "toxic", "clean"])

    return labelled.mapInArrow(run, "kind int, term string, toxic long, clean long").groupBy("kind", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _lookup(texts: pa.Array, terms: dict[int, list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, term number) of the terms that each text holds, each once."""
    owner, codes, values = term_columns(texts)
    total, offset, found = sum(map(len, terms.values())) or 1, 0, [np.empty(0, np.int64)]
    for kind, known in terms.items():
        if known and len(codes):
            at = pc.index_in(values[kind], value_set=pa.array(known, pa.string()), skip_nulls=True).fill_null(-1).to_numpy()[codes]
            found.append(owner[at >= 0] * total + at[at >= 0] + offset)
        offset += len(known)
    return np.divmod(np.unique(np.concatenate(found)), total)


def spread(labelled: DataFrame) -> DataFrame:
    """``labelled`` (text, toxic) with one of each group of near-copies: texts of one label that share a shingle minimum.

    Copies would make their own words look like signs of their label.  A text without words is near only to its like.
    """
    factors = np.random.default_rng(8).integers(0, 2**63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mins = np.array([[(h * f).min() if len(h) else 0 for f in factors] for h in (shingle_hashes(t.as_py().encode(), 5) for t in batch.column(0))], dtype=np.uint64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(mins[:, n].view(np.int64)) for n in range(4))], names=["text", "toxic", "m0", "m1", "m2", "m3"])

    marked = labelled.mapInArrow(run, "text string, toxic int, m0 long, m1 long, m2 long, m3 long")
    for n in range(4):
        first = F.struct("text", "toxic", *[f"m{m}" for m in range(4)])
        marked = marked.groupBy("toxic", f"m{n}").agg(F.min(first).alias("r")).select("r.*")
    return marked.select("text", "toxic")


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 25, prior_weight: float = 0.5, strong: float = 0.6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of the rows of a 0/1 vote matrix, each voter's rates of voting (clean, toxic), and voter correlations.

    A latent class model by expectation maximisation.  A row's posterior comes from its votes alone; the given labels serve
    as a prior of the voters' rates, of weight ``prior_weight`` against the posteriors.  Given the class, voters that go
    together would count twice; so a voter's evidence is divided by 1 + the sum of its correlations over ``strong`` with
    the others.
    """
    sure = np.stack([1.0 - given, given])
    posterior, correlation = given.astype(float), np.eye(votes.shape[1])
    shares = np.zeros((2, votes.shape[1]))
    for _ in range(rounds):
        weight = (1 - prior_weight) * np.stack([1 - posterior, posterior]) + prior_weight * sure
        shares = (weight @ votes + 0.5 * votes.mean(axis=0) + 0.01) / (weight.sum(axis=1, keepdims=True) + 1.0)
        shares = np.clip(shares, 1e-5, 1 - 1e-5)
        rest = votes - weight.T @ shares
        deviation = np.sqrt((rest**2).mean(axis=0))
        # few texts, or voters that the class explains whole, leave no more than chance to correlate
        correlation = (rest.T @ rest) / len(votes) / (np.outer(deviation, deviation) + 2 / len(votes))
        together = np.where(correlation > strong, correlation, 0)
        np.fill_diagonal(together, 1)
        trust = 1 / together.sum(axis=1)
        on, off = np.log(shares[1] / shares[0]), np.log((1 - shares[1]) / (1 - shares[0]))
        prior = np.clip(weight[1].mean(), 1e-4, 1 - 1e-4)
        logit = np.log(prior / (1 - prior)) + votes @ (trust * on) + (1 - votes) @ (trust * off)
        posterior = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
    return posterior, shares, correlation


def fit_linear(rows: np.ndarray, terms: np.ndarray, labels: np.ndarray, size: int, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 features and soft labels; copies of each text with most terms left out, so that a
    text with few of the terms is judged well."""
    rng, all_rows, all_terms, all_labels = np.random.default_rng(3), [rows], [terms], [labels]
    for copy in range(1, 5):
        kept = rng.random(len(rows)) < 0.25
        some = np.isin(np.arange(len(labels)), rows[kept]) | ~np.isin(np.arange(len(labels)), rows)
        number = np.cumsum(some) - 1 + sum(map(len, all_labels))
        all_rows.append(number[rows[kept]])
        all_terms.append(terms[kept])
        all_labels.append(labels[some])
    r, t, y = map(np.concatenate, (all_rows, all_terms, all_labels))
    weights, bias, speed = np.zeros(size), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), np.zeros(size + 1)
    curvature = np.bincount(t, minlength=size) / len(y) / 4 + 1e-3
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(np.bincount(r, weights=weights[t], minlength=len(y)) + bias))) - y
        gradient = np.append((np.bincount(t, weights=error[r], minlength=size) / len(y) + 1e-5 * weights) / curvature, error.mean() * 4)
        speed = 0.9 * speed + gradient
        weights, bias = weights - 0.05 * speed[:-1], bias - 0.05 * speed[-1]
    return weights, float(bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 20_000, voters: int = 256, features: int = 1024, chance: float = 0.05) -> Toxicity:
    """Learn from the rows of ``labels`` (id, toxic) that ``docs`` holds, at most ``train_rows`` of them (by hash of the id).

    Labels other than 0 and 1 and null ids don't count; of repeated labels of an id the larger counts; other columns are
    ignored.  Terms are mined if a likelihood ratio ties them to toxicity beyond what one of all candidates would show by
    ``chance``; the driver sees at most ``features`` of them and the sample's term numbers.  Without usable labels of both
    kinds (an empty table, say) every score is one half or less.
    """
    wanted = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    wanted = wanted.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    sample = checkpointed(spread(rows.join(F.broadcast(wanted), "id").select("text", "toxic")))
    n = dict(sample.groupBy("toxic").count().collect())
    toxic_n, clean_n = n.get(1, 0), n.get(0, 0)
    if not toxic_n or not clean_n:
        return Toxicity({k: [] for k in KINDS}, np.empty(0), -1.0)
    share = toxic_n / (toxic_n + clean_n)
    counted = checkpointed(count_terms(sample).where("toxic > 0"))
    both = F.col("toxic") + F.col("clean")
    part = lambda seen, at: F.when(seen > 0, seen * F.log(seen / (both * at))).otherwise(0.0)
    gain = 2 * (part(F.col("toxic"), F.lit(share)) + part(F.col("clean"), F.lit(1 - share)))
    least = 2 * float(np.log(max(counted.count(), 1) / chance))
    chosen = counted.withColumn("gain", gain).where((F.col("gain") >= least) & (F.col("toxic") >= 4 * share / (1 - share) * F.col("clean")))
    top = chosen.orderBy(F.desc("gain"), "kind", "term").limit(features).collect()

    lexicon = sorted({w for words in LEXICONS.values() for w in words})
    begun = {name: sorted({w[:BEGINNING] for w in LEXICONS[name] if len(w) > BEGINNING}) for name in BEGUN}
    fixed = {0: lexicon, BEGINNING: sorted({b for some in begun.values() for b in some})}
    terms = {k: list(dict.fromkeys([*fixed.get(k, []), *(r.term for r in top if r.kind == k)])) for k in KINDS}
    place = {(k, t): n for n, (k, t) in enumerate((k, t) for k in KINDS for t in terms[k])}

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, "text"):
            owner, term = _lookup(batch.column(0), terms)
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(term.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1)], names=["terms", "toxic"])

    held = sample.mapInArrow(vote, "terms array<int>, toxic int").toArrow()
    lists, given = held.column("terms").combine_chunks(), held.column("toxic").to_numpy().astype(float)
    rows_, terms_ = np.repeat(np.arange(len(given)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy().astype(np.int64)

    def voted(some: list[int], least: int = 1) -> np.ndarray:
        """Whether each text holds ``least`` of some terms."""
        return (np.bincount(rows_[np.isin(terms_, some)], minlength=len(given)) >= least).astype(np.float64)

    votes = [voted([place[0, w] for w in words]) for words in LEXICONS.values()]
    votes += [voted([place[BEGINNING, b] for b in some]) for some in begun.values()]
    votes += [voted([place[0, w] for w in lexicon], SEVERAL)]
    votes += [voted([place[r.kind, r.term]]) for r in top[:voters]]
    posterior, _, _ = label_model(np.column_stack(votes), given)
    weights, bias = fit_linear(rows_, terms_, posterior, len(place))
    hand_back()
    return Toxicity(terms, weights, bias, posterior, given)


def score_batches(model: Toxicity, column: str, scores: str, below: float | None = None):
    """Task that adds ``scores`` to batches, or, with ``below``, keeps the rows whose score is less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, column):
            owner, term = _lookup(pc.fill_null(batch.column(column), ""), model.terms)
            logit = np.bincount(owner, weights=model.weights[term], minlength=batch.num_rows) + model.bias
            found = pa.array(1 / (1 + np.exp(-np.clip(logit, -40, 40))))
            if below is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, scores])
            else:
                yield batch.filter(pc.less(found, below))

    return run


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, score, predicted) of every row's whole text; null counts as empty.

    Repeated rows are scored alike, null ids like others; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    slim = Toxicity(model.terms, model.weights, model.bias)
    scored = rows.mapInArrow(score_batches(slim, "text", "score"), f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, text string, score double")
    return scored.select(id_col, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Toxicity, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs``, all columns, without the rows that score ``threshold`` or more; null texts count as empty."""
    model = Toxicity(model.terms, model.weights, model.bias)
    return docs.mapInArrow(score_batches(model, text_col, "", threshold), docs.schema)


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels of the folds that may be learnt from; fold 1 of 3 is held out."""
    return labels.where(fold(id_col, 3) != 1)
