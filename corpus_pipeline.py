"""Five stages from raw documents to token ids, each one of the corpus operators.

Each stage takes (spark, docs, sf_dir) and works on what the one before it kept, written as Parquet and read again. All but the last keep the columns of
docs, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.llm import bpe, jaccard, mixing, quality, suffixes
from repograph.llm.common import read, shared_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned list keep. Null and empty texts fail the base rule and go; rows that repeat are judged alike."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8. Of repeated rows one stays; texts without words, null ones too, all stay."""
    return jaccard.keep_one(docs, width=5, percent=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 200 bytes that occur more than once; a text may end up empty, a null one stays null. All rows and columns stay."""
    return suffixes.remove_repeats(docs, length=200)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to three times. Texts without words are never taken; a null source is a source of its own."""
    return mixing.mix_documents(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids of each document, one row for each row; a null or empty text has no ids."""
    encoded = bpe.encode_documents(docs)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mixing_sources),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

#: The learned rules of the first stage and the shuffles of the others can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = shared_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
