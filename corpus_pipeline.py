"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Defined results of every stage: an empty table gives an empty table of the stage's columns, texts are read whole at
any length, and other columns of ``documents``, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import free_name, table
from tamarack.llm.exact_dedup import exact_unique
from tamarack.llm.mixing import mixed
from tamarack.llm.packing import packed
from tamarack.llm.quality import THRESHOLD, with_quality
from tamarack.llm.shingle_join import one_per_component
from tamarack.session import stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; repeated rows and equal texts fare alike.

    A null or empty text gets the score of the model's bias alone and stays or goes by it.
    """
    score = free_name(docs.columns, "quality_score")
    return with_quality(docs, table(spark, sf_dir, "labels"), score).filter(F.col(score) >= THRESHOLD).drop(score)


def one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest original stays, of equally long ones the smallest id (null last).

    Null, empty and blank texts are equal to each other, so one of all these stays; of repeated rows one stays.
    """
    return exact_unique(docs)


def one_of_similar_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar sets of shingles, the one of smallest id (null last) stays.

    Null texts and texts without words are linked with nothing and stay; of rows that agree in id and text one stays.
    """
    return one_per_component(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks, at most twice; rows that repeat an id are drawn alike.

    A null source is a source; null texts and texts without words are taken as their source's rate says.
    """
    return mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in the sequences.

    A null or empty text is the closing id alone; a document longer than a sequence is cut into pieces; repeated rows
    are packed each for itself.
    """
    return packed(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", one_of_equal_texts),
    ("n-gram Jaccard join", one_of_similar_texts),
    ("mixing sources to target weights", mixed_sources),
    ("best-fit packing", packed_sequences),
]

#: The classifier is trained, so SQL cannot tell which documents it keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
