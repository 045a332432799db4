"""Exact hybrid retrieval: cosine plus a bonus for distinctive words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import lexical_share

# Weight of the lexical share, floor of a vector's length, chunks per document, result size.
LEXICAL_WEIGHT = 0.15
NORM_FLOOR = 1e-9
PER_DOCUMENT = 3


def cosine(df: DataFrame, vector: str, query: Sequence[float], out: str = "cosine") -> DataFrame:
    """Adds the cosine with a query vector and drops the vectors.

    Arrow batches are scored with one matrix product each, where the rows lie. The query vector is a
    constant of the task; nothing is shuffled.
    """
    q = np.asarray(query, dtype=np.float64)
    q = q / max(float(np.linalg.norm(q)), NORM_FLOOR)
    dim = len(q)
    keep = [c for c in df.columns if c != vector]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(vector)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            good = lengths == dim  # a missing or odd-sized vector scores null
            scores = np.full(len(lists), np.nan)
            if good.any():
                flat = lists.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                m = flat.reshape(-1, dim)
                scores[good] = (m @ q) / np.maximum(np.linalg.norm(m, axis=1), NORM_FLOOR)
            column = pa.array(scores, mask=~good)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), column], names=[*keep, out])

    return df.select(*keep, vector).mapInArrow(score, schema)


def cosine_column(vector: Column, query: Sequence[float]) -> Column:
    """The same as an expression, for short vectors beside other expressions."""
    q = np.asarray(query, dtype=np.float64)
    q = q / max(float(np.linalg.norm(q)), NORM_FLOOR)
    other = F.array(*[F.lit(float(x)) for x in q])
    v = F.transform(vector, lambda x: x.cast("double"))

    def total(products: Column) -> Column:
        return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)

    length = F.sqrt(total(F.transform(v, lambda x: x * x)))
    return total(F.zip_with(v, other, lambda a, b: a * b)) / F.greatest(length, F.lit(NORM_FLOOR))


def hybrid_score(cos: Column, folded: Column, terms: Sequence[str]) -> Column:
    """Cosine plus the weighted share of the terms; without terms the cosine alone."""
    return cos + LEXICAL_WEIGHT * lexical_share(folded, list(terms))


def top_k(df: DataFrame, score: str, k: int, ties: Sequence[str]) -> DataFrame:
    """Best k rows; each task keeps only its own best k."""
    return df.orderBy(F.col(score).desc(), *ties).limit(k)


def capped_top_k(df: DataFrame, score: str, k: int, doc: str, ties: Sequence[str], per_doc: int = PER_DOCUMENT) -> DataFrame:
    """Best k rows with at most ``per_doc`` of each document.

    The rank filter is pushed into the window as a per-task group limit, so a document with very many
    chunks sends only a few rows per task.
    """
    order = [F.col(score).desc(), *[F.col(t) for t in ties]]
    ranked = df.withColumn("r__", F.row_number().over(Window.partitionBy(doc).orderBy(*order)))
    return top_k(ranked.filter(F.col("r__") <= per_doc).drop("r__"), score, k, ties)


def facets(df: DataFrame, agency: str = "", kind: str = "", agency_column: str = "agency", kind_column: str = "kind") -> DataFrame:
    """Agency as case-insensitive substring and type by equality, before anything is scored."""
    out = df
    if agency:
        out = out.filter(F.contains(F.lower(agency_column), F.lit(agency.lower())))
    if kind:
        out = out.filter(F.col(kind_column) == kind)
    return out


def rendered(df: DataFrame, score: str, ties: Sequence[str], title: Column, agency: Column, kind: Column, day: Column, url: Column, text: Column) -> DataFrame:
    """Result rows as text blocks. The input is already a top-k of at most ten rows."""
    w = Window.orderBy(F.col(score).desc(), *ties)
    ranked = df.withColumn("rank", F.row_number().over(w).cast("bigint"))
    block = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), title, F.lit(" — "), agency, F.lit(" ("), kind, F.lit("), coletado em "),
        day, F.lit(", relevância "), F.format_number(score, 2), F.lit("\nURL: "), url, F.lit("\n"), text,
    )
    return ranked.withColumn("block", block)
