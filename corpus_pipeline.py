"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing.

Null and empty texts fail the quality rules and go. Rows equal in all columns
stay through the first stage and are one row after the second. A null doc_id comes
after all others. An empty table stays empty through all stages. Very long texts pass whole; each stage holds one of them in a task at a time. Columns
beyond those of documents pass all stages but the last.

``STAGES`` has (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corposcope.llm import mixing, packing, quality_rules, simhash, substrings
from corposcope.llm.common import durable, table
from corposcope.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules keep."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose sets of five-word shingles are 0.8 alike or more."""
    return simhash.keep_one(docs, similarity=0.8, width=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; n_chars follows the text. Emptied documents go."""
    found = substrings.remove_repeats(docs, passage_words=50).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return found.filter((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\t\n\x0b\f\r", "     ")) != "")).select(*(f"`{c}`" for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path(spark), capacity=2048)


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: Classes by similarity, seeded picks and packing are not expressible in SQL; each stage is held against a plain version in ``tests/llm/test_pipeline.py``.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to all that its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)
    return docs
