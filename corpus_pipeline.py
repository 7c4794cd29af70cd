"""A corpus pipeline over ``documents``: five stages, each one of the training-data operators.

Every stage gets all rows that the one before kept and returns the columns of ``documents``, the
last one the encoded corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterel.llm import bpe, decontam, line_dedup, quality, simhash
from rasterel.llm.common import table, written
from rasterel.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that a document with a smaller id has as well; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: SimHash links of five-word shingles, verified and completed by a Jaccard of 0.8 or more."""
    return simhash.one_of_each_group(docs, shingle=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go, in whatever case."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with digests of ids and decoded text."""
    return bpe.encode(docs, tokenizer_path()).drop("text", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("line_dedup", drop_lines),
    ("near_duplicates", one_of_each),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: The classifier and the encoder are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the whole table, each one's rows written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, written(docs) if k else docs, sf_dir)
    return docs
