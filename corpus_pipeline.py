"""From raw documents to packed sequences: five stages, each by one operator.

Each stage reads all that the one before it kept; all but the last return the columns of documents.

Defined results, of every stage:
    null text, empty text   no word and no letter: the first stage rejects them
    very long texts         judged, compared and packed whole
    null identifier         judged like any other; of exact copies an identified row stays before one without, near
                            copies without an identifier stay; packed with doc_id null
    ties                    the smallest identifier stays; a score at the threshold stays
    repeated rows           exact dedup leaves one; rows that share an identifier but no text stay or go together after it
    empty table             empty result
    further columns         kept as they are by all stages but packing, whatever their names
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import exact_dedup, langid, minhash, packing, quality
from lattica.llm.common import materialise, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is under the threshold go."""
    return quality.keep(docs, quality.fit(docs))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or unlike all languages learned from the labelled rows, go."""
    return langid.keep(docs, langid.learn(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text but for white space, the one with the smallest identifier stays."""
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over five-word shingles, one stays."""
    return minhash.keep_least(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of the documents in sequences of at most 1024, one row a piece."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("minhash_dedup", near_duplicates),
    ("packing", packed),
]

#: No stage but exact dedup can be said in SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
