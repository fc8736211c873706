"""A corpus made ready for training, in stages that each take and return documents (the last: packed pieces).

All stages keep the columns that they get, whatever their names, read null texts as empty ones, take rows with a null doc_id
like others, and give no rows for none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumaveil.llm import mixing, near, packing, pii, toxicity
from lumaveil.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine, fitted on the labels, does not reject.

    Equal texts get one score; repeated rows stay or go together; without labels of both kinds nothing goes.
    """
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles at a Jaccard similarity of 0.8 or more.

    The smallest doc_id stays, and of repeated rows with it one; rows that share a doc_id but not a text lose none of them;
    rows with a null doc_id all stay; texts without words are copies of one another.
    """
    return near.keep_first(docs, width=5, at_least=0.8)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; all rows stay, and texts without any as they are."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0 to 2 times; ties go by a hash of the content, so that reruns agree."""
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, packed into windows; a document without words is its end mark, a long one many pieces."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each result written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
