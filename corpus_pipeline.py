"""The corpus pipeline: quality rules, line deduplication, near duplicates, personal data, packing.

Each stage works on all that the one before it kept, and reads it from Parquet. All but the
last return the columns that they are given, those of ``documents`` and any others, in their order; ``n_chars`` is that of the text as it
then is. Rows are documents: those that share an id, or have none, are told apart by their texts. An empty table goes through all stages and gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphcall.llm import jaccard_join, line_dedup, packing, pii, quality
from graphcall.llm.shared import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    """``out`` with the columns of ``docs``, n_chars counted anew; a null text has none."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast("long"))
    return out.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail.

    Null and empty texts, and all of fewer than 50 words, fail. Each row is judged by itself, whole: repeated rows all stay or all go, a null id is no
    reason for either, and a very long text takes several times its bytes of a worker.
    """
    return _counted(quality.cleaned(docs), docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line of ten characters or more stays only in the document of the smallest id that holds it.

    A null id is smaller than all others; rows that share an id, ties, are one document here and keep the line alike. This stage rejects no document: one that
    loses all its lines, as a null text, goes on with an empty text, and the next stage keeps one of all that have no words.
    """
    return _counted(line_dedup.without_repeated_lines(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word similarity 0.8 connect, the one with the smallest id stays, with all its columns.

    Groups are of rows: rows of one id, or of none, stay once for each of their groups; a null id comes last. Of rows that repeat id and text one
    stays; texts without words, null ones too, are one group. Very long texts count with all their words.
    """
    return _counted(jaccard_join.one_of_each_group(docs, size=5, threshold=0.8), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Marks stand in place of personal data; a row's other columns, its null id or null text stay as they are, and every row stays."""
    return _counted(pii.without_personal_data(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens: the columns of ``packing.PIECES``, sequence_id and offset.

    Null and empty texts are their end token alone, long ones several pieces; repeated rows and rows without an id are all placed. Other columns are left out.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("best-fit packing", packed),
]

#: Tokenizers and a trained model take part, so SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, stored(docs, "stage") if k else docs, sf_dir)
    return docs
