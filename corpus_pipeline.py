"""From raw documents to training sequences: five stages, each one of the corpus operators.

Each stage works on all that the one before it kept, and hands on the columns of `documents`; the
last returns one row for each piece of a packed document.  A stage's output is written as Parquet
and read again, so a lost executor costs its own tasks only.

Defined results: a null or empty text fails the quality rules; documents with a null id are judged by
quality and redacted, but link with nothing and lose no passage; rows repeated under one id stay
together; columns beyond those of `documents` are carried along; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import jaccard_join, packing, pii, quality_rules, substring_dedup
from meterlake.llm.common import cut, prepare
from meterlake.llm.queries import tokenizer_file


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a changed text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates."""
    prepare(spark)
    found = jaccard_join.classes(docs.select("doc_id", "text"))
    gone = found.filter("component_id < doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of smaller id has; others are left as they are."""
    prepare(spark)
    found = substring_dedup.dedup(docs.select("doc_id", "text")).filter("n_removed > 0").select("doc_id", "kept").distinct()
    joined = docs.join(found, "doc_id", "left").withColumn("text", F.coalesce("kept", "text"))
    return _counted(joined.select(*docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each personal datum replaced by its kind."""
    prepare(spark)
    return _counted(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    prepare(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("PII", personal_data),
    ("best-fit packing", packed),
]

#: Tokenization and the tagger are beyond SQL; tests/llm holds the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
