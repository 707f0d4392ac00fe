"""A corpus pipeline of the subpackage's operators over ``documents``.

Stages take (spark, docs, sf_dir); all but the last return the columns of documents, further ones too.  ``docs`` must be read
from files or a checkpoint, as some stages read it more than once.  Null and empty texts count as empty; null and repeated
ids, repeated rows and very long texts are rows like others; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import bpe, exact_dedup, minhash, mixing, simhash, toxicity
from chronolith.llm.common import ROW_KEY, checkpointed, drop_rows, shared_folder, table, with_row_key


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.7; it learns from the labels of two of three folds.

    Without labels of both kinds nothing is rejected.
    """
    model = toxicity.train(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the largest doc_id (null ids last, then the last row), of those with equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id (null ids last, then the first row), of each group that links join.

    Documents link by operator 4, whose fingerprints of four-word shingles differ in 4 bits or fewer, found by its pivot
    tables; and by a five-word shingle similarity of 0.8 or more, as most such pairs differ in more bits (see the README's
    figures).
    """
    keyed = with_row_key(docs, "doc_id")
    prints = checkpointed(simhash.fingerprints(keyed, ROW_KEY, words=4))
    links = simhash.near_links(checkpointed(prints.select("fp").distinct()), bits=4)
    found = minhash.near_duplicates(keyed, words=5, prints=prints, links=links)
    return drop_rows(keyed, found.where(F.col(ROW_KEY) != F.col("kept")))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents kept or dropped whole, so that rough text makes up a twentieth of the expected tokens.

    Without labels all documents are of one mixture, and their rates keep as near to 1 as the targets allow.
    """
    labels = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.apply_mix(docs, labels, {"clean": 0.95, "rough": 0.05}, max_rate=1.0)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of every document."""
    return bpe.round_trip(docs, bpe.default_tokenizer(spark), keep_ids=True)


STAGES = [("toxicity", reject_toxic), ("exact_dedup", drop_exact), ("simhash", drop_near), ("mixing", mix_domains), ("bpe", tokenize)]
#: SQL cannot express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
