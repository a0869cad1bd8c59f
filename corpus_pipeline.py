"""A corpus cleaned, deduplicated, mixed and packed: five stages over the documents table.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; what it
returns is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.storage import shared_folder
from plumbline.llm import mixing, ngram_join, packing, quality_classifier, substring_dedup
from plumbline.llm.tables import read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies share four fifths of their five-word shingles.
NEAR_COPIES = ngram_join.Rule(5, (80, 100))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    judged = quality_classifier.classify(docs, read(spark, sf_dir, "labels"), others=COLUMNS[1:])
    return judged.where("predicted = 1").select(*COLUMNS)


def keep_one_of_near_copies(
    spark: SparkSession, docs: DataFrame, sf_dir: str, rule: ngram_join.Rule = NEAR_COPIES
) -> DataFrame:
    """Of each group of documents linked by ``rule`` the one of the smallest doc_id.

    Rows of equal keys, or without one, whose texts are linked are one document.
    """
    return ngram_join.first_of_components(docs.select(*COLUMNS), rule=rule)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that a document of smaller doc_id holds."""
    kept = substring_dedup.dedup(docs, others=("lang", "source", "n_chars"))
    shorter = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.where("n_removed = 0 or n_removed < n_words").withColumn("n_chars", shorter).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    taken = mixing.mix(docs, others=("text", "lang", "n_chars"))
    times = F.explode(F.expr("sequence(1, copies)"))
    return taken.where("copies > 0").withColumn("time", times).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; a document mixed in twice is packed twice."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier is fitted and the mix is drawn, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and reread."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return result
        result.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
