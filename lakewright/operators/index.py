"""Chunk index: embedding hook, signatures, integrity."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, words
from ..session import materialize


def embed_input(title: Column, text: Column) -> Column:
    """The title gives its context to every chunk."""
    return F.concat_ws("\n", title, text)


def searchable(chunks: DataFrame, title: str = "title", text: str = "text", out: str = "norm") -> DataFrame:
    """Adds the folded title and text, so that searches compare words without folding again."""
    return chunks.withColumn(out, fold(F.concat_ws(" ", title, text)))


def hashing_embedder(dim: int = 256) -> Callable[[DataFrame, str, str], DataFrame]:
    """Default embedder: hashed term counts weighted by inverse document frequency, at unit length.

    Deterministic and model-free. A hosted model takes its place through the same signature
    ``(df, text column, output column) -> df``, usually with ``mapInPandas`` over batches.
    """
    def run(df: DataFrame, text: str, out: str) -> DataFrame:
        terms = HashingTF(inputCol="words__", outputCol="tf__", numFeatures=dim)
        # counted once and kept as a table: fitting and transforming both need the counts
        counted = materialize(terms.transform(df.withColumn("words__", words(F.col(text)))).drop("words__"), "term-counts")
        weights = IDF(inputCol="tf__", outputCol="idf__").fit(counted)
        unit = Normalizer(inputCol="idf__", outputCol="unit__").transform(weights.transform(counted))
        return unit.withColumn(out, vector_to_array("unit__", "float32")).select(*df.columns, out)

    return run


def changed_sources(current: DataFrame, indexed: DataFrame, source: str = "source", doc: str = "doc_id") -> DataFrame:
    """Per source: does the set of current documents differ from the indexed set?

    The sets are compared by counting documents that are on one side only, grouped by document first, so
    that no set is ever held in one place.
    """
    sides = current.select(source, doc, F.lit(1).alias("c__"), F.lit(0).alias("i__")).unionByName(
        indexed.select(source, doc, F.lit(0).alias("c__"), F.lit(1).alias("i__"))
    )
    per_doc = sides.groupBy(source, doc).agg(F.max("c__").alias("c__"), F.max("i__").alias("i__"))
    return per_doc.groupBy(source).agg(
        F.sum("c__").alias("current"), F.sum("i__").alias("indexed"),
        F.count_if(F.col("c__") != F.col("i__")).alias("differing"),
    ).withColumn("changed", F.col("differing") > 0)


def whole_sources(meta: DataFrame, vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sources whose text rows and vectors agree in number; half-written ones are left out."""
    a = meta.groupBy(*keys).agg(F.count("*").alias("texts"))
    b = vectors.groupBy(*keys).agg(F.count("*").alias("vectors"))
    return a.join(b, list(keys)).filter(F.col("texts") == F.col("vectors"))


def pair_by_position(left: DataFrame, right: DataFrame, keys: Sequence[str], left_array: str, right_array: str) -> DataFrame:
    """Item i of one array beside item i of the other, per batch."""
    a = left.select(*keys, F.posexplode(left_array).alias("pos", "left"))
    b = right.select(*keys, F.posexplode(right_array).alias("pos", "right"))
    return a.join(b, [*keys, "pos"])


def write_index(chunks: DataFrame, path: str, source: str = "source") -> None:
    """Replaces the partitions of the sources that are present, nothing else."""
    (
        chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        .partitionBy(source).parquet(path)
    )
