"""Documents into overlapping chunks that respect headings and paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Chunk size, overlap and where a new block begins.
LIMIT = 1500
OVERLAP = 200
BLOCK_START = re.compile(r"\n(?=#{1,6} )|\n{2,}")
JOINT = "\n\n"


def body_of(text: str) -> str:
    """Text behind the front matter."""
    if not text.startswith("---"):
        return text
    head, mark, rest = text.partition("\n---\n")
    return rest if mark else head


def _pieces(block: str, limit: int, overlap: int) -> list[str]:
    """A long block as overlapping pieces; the last one may be short."""
    pieces, start = [], 0
    while len(block) - start > limit:
        space = block.rfind(" ", start, start + limit)
        end = space if space - start > limit // 2 else start + limit
        pieces.append(block[start:end])
        start = max(end - overlap, start)
    pieces.append(block[start:])
    return pieces


def chunk_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[str]:
    chunks: list[str] = []
    buffer = ""
    for block in BLOCK_START.split(body_of(text)):
        block = block.strip()
        if not block:
            continue
        *full, tail = _pieces(block, limit, overlap)
        if full:
            chunks += ([buffer] if buffer else []) + full
            buffer = ""
        if not buffer:
            buffer = tail
        elif len(buffer) + len(JOINT) + len(tail) > limit:
            chunks.append(buffer)
            buffer = buffer[-overlap:] + JOINT + tail
        else:
            buffer += JOINT + tail
    return chunks + ([buffer] if buffer else [])


def chunks_of(docs: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per chunk, numbered within its document; other columns are kept."""
    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([chunk_text(t or "", limit, overlap) for t in batch])

    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.posexplode(split(F.col(text))).alias("chunk", "text"))
