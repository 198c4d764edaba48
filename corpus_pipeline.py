"""A training corpus from the documents: toxic texts and texts of poor quality go, one of each group of near copies stays,
sources are mixed to target weights, and what is left is encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lantern.llm import bpe, mixing, neardup, quality, queries, toxicity
from lantern.llm.common import remove, scratch, table

#: The mixture's tokens as a share of those that are left, and how often a document may come.
SHARE, EPOCHS = 0.8, 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. It is fitted on the labels of the documents here. Null texts count
    as empty ones, which stay; rows of a null or repeated id stay or go each by its text."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts stay; rows of a null or repeated id stay or go
    each by its text."""
    return quality.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays. Rows with a null id go; of a repeated id at most
    one row stays; all texts without words are one group."""
    return neardup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside the mixture go; those that it takes twice come twice. Rows with a null id go, rows of a repeated id
    count each, null lang and source are sources of their own, and texts without words are taken as far as the mixture's
    prefix goes."""
    return mixing.taken(docs, queries.domain(), SHARE, EPOCHS, weights=queries.target_weights(spark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded bytes. A null text counts as empty; repeated rows come each."""
    return bpe.token_digests(docs, queries.RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near copies", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]
#: The classifiers, the join and the encoding aren't expressed in SQL; the tests of the stages use plain versions and labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each other stage's documents are a table in the shared folder, which goes when the next one
    is written; that of the last but one stays, as the result reads it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        (kept := stage(spark, docs, sf_dir)).write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
