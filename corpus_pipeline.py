"""A training corpus from raw documents, in five stages of the operators in ``quarry.llm``.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
give the columns of ``documents``. ``run`` writes what a stage gives to the
shared folder and reads it for the next.

In every stage: extra columns ride along whatever their names, an empty table
gives no rows, texts of any length are worked on as wholes, and a row is a
document, so rows that repeat an id are each judged. Null ids stay null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import table, written
from quarry.llm.mixing import chosen
from quarry.llm.ngram_join import one_of_each
from quarry.llm.packing import packed
from quarry.llm.personal_data import without_personal_data
from quarry.llm.toxicity import without_toxic
from quarry.session import ship

#: Languages weigh alike but for English, sources within a language alike.
WEIGHTS = {("web", "en"): 3}
SHARE, EPOCHS, SEED = 0.9, 1, 1


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts stay, equal texts stay or go together."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id: five-word shingles, Jaccard 0.8 or more.

    Repeated rows leave one. Texts without words, null ones too, are near nothing and stay.
    """
    ship(spark)
    return one_of_each(docs, n=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced by their kind; n_chars follows where a text changed. Null texts stay null, equal texts change alike."""
    ship(spark)
    return without_personal_data(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SHARE of all words, spread over languages and sources by weight.

    Texts without words go, as they have nothing to budget. Null languages and
    sources are nodes of their own; ties in the order are broken by the row's place.
    """
    ship(spark)
    return chosen(docs, WEIGHTS, SHARE, EPOCHS, SEED).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 tokens; a null or empty text is a piece with the closing id."""
    ship(spark)
    return packed(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), {"<|endoftext|>": 50256})


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]

#: Classifiers and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
