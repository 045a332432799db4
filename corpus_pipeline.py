"""The corpus pipeline: quality rules, line dedup, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of ``documents``; ``n_chars`` follows the text. Nulls, empty texts, repeated rows and extra columns are handled
as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm import host_rules, line_dedup, ngram_join, packing, span_dedup
from lakewright.llm.common import documents, fresh, store
from lakewright.llm.queries import vocabulary
from lakewright.session import configure


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or come from a rejected host, go."""
    return host_rules.keep_documents(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or similar to an earlier line go; documents stay, also with no text left."""
    return _measured(line_dedup.dedup_lines(docs, size=1, least=1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, the one with the smallest doc_id stays, as one row.

    Documents without words, and rows without doc_id, are in no group and stay. Unlike texts under one doc_id are one
    document to the join; each of its texts stays.
    """
    groups = store(ngram_join.linked_documents(docs, size=5, percent=80), "linked")
    gone = groups.where("doc_id != component_id").select("doc_id").distinct()
    again = groups.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = store(again, "repeated-rows")  # rows of one doc_id that came more than once
    key = fresh(docs, "_doc")
    own = F.col("doc_id").cast("long")
    kept = docs.join(gone.withColumnRenamed("doc_id", key), own == F.col(key), "left_anti")
    if again.isEmpty():
        return kept
    again = again.withColumnRenamed("doc_id", key)
    once = kept.join(again, own == F.col(key), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, own == F.col(key), "left_anti").unionByName(once)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences in runs that stand elsewhere before go; documents stay, also with no text left."""
    return _measured(span_dedup.dedup_spans(docs, ends=True, by_content=True))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 2048."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), room=2048, end=0)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", sequences),
]

#: Hash joins and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = documents(configure(spark), sf_dir)
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
