"""The corpus pipeline: stages over documents, each on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs.  All but the last return the columns of documents.

All stages: a null text counts as empty; texts of any length are read whole; an empty table gives an empty result; further
columns stay as they are (until packing, which has columns of its own), whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracegauge.llm import exact_dedup, near_dedup, packing, quality_rules, toxicity
from tracegauge.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold stay.

    Repeated rows and equal texts have equal scores and stay or go together; empty texts are scored like others; with
    labels of one class only every score is the smoothed share of label 1, and without labels it is 0.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the quality threshold stay.

    Empty texts fail the base rules (fewer than 50 words); repeated rows and equal texts stay or go together.
    """
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id stays.

    Texts are equal up to runs of white space; all empty and null texts are one group; a null doc_id sorts last; of
    rows with the same doc_id and text one stays.
    """
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the smallest doc_id stays.

    Links reach on from one document to the next.  Texts without words are linked with nothing and stay; a text of fewer
    than five words has all of them as its one shingle.
    """
    return near_dedup.keep_first(docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in training sequences.

    An empty text is one piece, its end token; repeated rows are packed each; a doc_id that is no integer is refused.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("packing", pack),
]

#: Two stages are trained models and one joins signatures: not expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            folder = shared_folder(spark, f"pipeline-{i}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
