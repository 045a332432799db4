"""Token ids in files of 64-bit words by Simple-8b coding, and back.

A word has a selector of 4 bits and 60 bits for as many values as fit it (fixed values of the scheme, below). Values of
2**60 - 1 or more are escapes: a word of ones under the last selector, and the value in a list of its own behind the
block's words. Ids are coded in blocks; the file's table has the place of each block, so blocks decode alone, and within
a block all words of one selector decode at once.

File: 8 bytes of magic; int64 numbers of blocks, documents and ids; per block int64 first byte, words, escapes and ids; per
document int64 doc_id, 1 if it has a doc_id, and ids; then the blocks. All little-endian.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import words as W
from .tokens import Encoder

#: Values per word and bits per value of each selector. The first two hold zeros only.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)

BLOCK = 1 << 16  #: ids per block
FILE_IDS = 1 << 22  #: ids per file, at least one document
MAGIC = b"LWS8B\x00\x00\x01"

_U = np.uint64
_TOP = _U((1 << 60) - 1)
_LIMITS = np.array([1 << b for b in BITS[1:]], _U)  #: a value's place among these says how many bits it needs
_ALLOWED = [int(np.searchsorted(_LIMITS, _U((1 << b) - 1), "right")) for b in BITS]


def encode_block(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of unsigned 64-bit values."""
    values = values.astype(_U)
    n = len(values)
    escapes = values[values >= _TOP]
    values = np.minimum(values, _TOP)
    # the widest of the next COUNTS[s] values decides whether selector s fits; behind the end, zeros fill a word
    need = np.zeros(n + 256, np.uint8)
    need[:n] = np.searchsorted(_LIMITS, values, "right")
    selector, widest, wide = np.full(n, 15, np.uint8), need, 1
    for s in range(14, -1, -1):  # from few values a word to many: the last that fits is the best
        while wide < COUNTS[s]:
            more = min(wide, COUNTS[s] - wide)
            widest = np.maximum(widest[:-more], widest[more:])
            wide += more
        np.copyto(selector, np.uint8(s), where=widest[:n] <= _ALLOWED[s])
    step = np.array(COUNTS, np.uint8)[selector].tobytes()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts, np.int64)
    chosen = selector[starts]
    padded = np.concatenate([values, np.zeros(256, _U)])
    out = chosen.astype(_U) << _U(60)
    for s in np.unique(chosen):
        if BITS[s]:
            at = np.flatnonzero(chosen == s)
            word = out[at]
            for k in range(COUNTS[s]):
                word |= padded[starts[at] + k] << _U(BITS[s] * k)
            out[at] = word
    return out, escapes


def decode_block(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of a block."""
    selector = (words >> _U(60)).astype(np.int64)
    counts = np.array(COUNTS, np.int64)[selector]
    starts = np.cumsum(counts) - counts
    out = np.zeros(n + 256, _U)
    for s in np.unique(selector):
        if BITS[s]:
            at = np.flatnonzero(selector == s)
            mask = _U((1 << BITS[s]) - 1)
            for k in range(COUNTS[s]):
                out[starts[at] + k] = (words[at] >> _U(BITS[s] * k)) & mask
    out = out[:n]
    if len(escapes):
        out[out == _TOP] = escapes
    return out


def to_bytes(ids: np.ndarray, docs: list[tuple[int | None, int]]) -> bytes:
    """A whole file: ``ids`` of all documents and (doc_id, number of ids) of each."""
    blocks = [(encode_block(ids[lo : lo + BLOCK]), min(BLOCK, len(ids) - lo)) for lo in range(0, len(ids), BLOCK)]
    head = 32 + 32 * len(blocks) + 24 * len(docs)
    table, at = [], head
    for (words, escapes), n in blocks:
        table.append((at, len(words), len(escapes), n))
        at += 8 * (len(words) + len(escapes))
    names = [(0 if d is None else d, int(d is not None), n) for d, n in docs]
    return b"".join(
        [MAGIC, np.array([len(blocks), len(docs), len(ids)], "<i8").tobytes(), np.array(table, "<i8").tobytes(), np.array(names, "<i8").tobytes()]
        + [part.astype("<u8").tobytes() for (words, escapes), _ in blocks for part in (words, escapes)]
    )


def from_bytes(data: bytes) -> tuple[np.ndarray, list[tuple[int | None, int]]]:
    """The ids and documents of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of this format")
    n_blocks, n_docs, n = np.frombuffer(data, "<i8", 3, 8).tolist()
    table = np.frombuffer(data, "<i8", 4 * n_blocks, 32).reshape(-1, 4).tolist()
    names = np.frombuffer(data, "<i8", 3 * n_docs, 32 + 32 * n_blocks).reshape(-1, 3).tolist()
    parts = [
        decode_block(np.frombuffer(data, "<u8", w, at), np.frombuffer(data, "<u8", e, at + 8 * w), k) for at, w, e, k in table
    ]
    ids = np.concatenate([*parts, np.zeros(0, _U)])
    if len(ids) != n:
        raise ValueError("the file is damaged")
    return ids, [(d if known else None, k) for d, known, k in names]


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI that tasks can open, under the cluster's default file system if it names none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_ids(docs: DataFrame, vocabulary: str, folder: str, end: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of every whole text, ``end`` behind each, in ascending doc_id order (null first) below ``folder``.

    Returns (task, seq, uri, n_docs, n_ids), one row per file, in the order of task and seq. A file is written under
    another name and moved, so a task that runs again replaces its files. Null and empty texts have the end id only.
    """
    spark = docs.sparkSession
    root = qualified(spark, folder)
    shared = spark.sparkContext.broadcast(vocabulary)
    tail = np.array([end], "<u4").tobytes()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = narrow.repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id")

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        task, encoder, system = context.partitionId(), Encoder.of(shared.value), None
        held, names, total, seq = [], [], 0, 0

        def flush():
            nonlocal held, names, total, seq, system
            name = f"{root}/part-{task:06d}-{seq:06d}.s8b"
            system, path = _open(name)
            brief = f"{path}.{context.taskAttemptId()}"
            with system.open_output_stream(brief) as out:
                out.write(to_bytes(np.frombuffer(b"".join(held), "<u4"), names))
            system.move(brief, path)
            row = [[task], [seq], [name], [len(names)], [total]]
            held, names, total, seq = [], [], 0, seq + 1
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["task", "seq", "uri", "n_docs", "n_ids"])

        if root.startswith("file:"):
            system, path = _open(root)
            system.create_dir(path, recursive=True)
        for batch in batches:
            for part in W.slices(batch):
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                    n = len(ids) // 4 + 1
                    if names and total + n > file_ids:
                        yield flush()
                    held += [ids, tail]
                    names.append((doc, n))
                    total += n
        if names:
            yield flush()

    manifest = ordered.mapInArrow(run, "task int, seq int, uri string, n_docs long, n_ids long")
    path = f"{folder}-manifest"
    manifest.write.mode("overwrite").parquet(path)
    return spark.read.schema(manifest.schema).parquet(path).orderBy("task", "seq")


def read_ids(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that ``write_ids`` returned.

    The driver adds up one number per file to know where each starts.
    """
    rows = files.orderBy("task", "seq").collect()
    base, named = 0, []
    for r in rows:
        named.append((r["uri"], base))
        base += r["n_ids"]
    places = spark.createDataFrame(named, "uri string, base long").repartition(max(1, len(named)), "uri")

    def run(batches):
        for batch in batches:
            for uri, base in zip(*(batch.column(c).to_pylist() for c in ("uri", "base"))):
                system, path = _open(uri)
                with system.open_input_stream(path) as data:
                    ids, docs = from_bytes(data.read())
                raw, at, out = memoryview(ids.astype("<u4").tobytes()), 0, []
                for doc, n in docs:
                    out.append((doc, base + at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])))
                    at += n
                columns = [pa.array(list(c), pa.int64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return places.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes ``docs`` to a fresh folder of the shared storage and returns what the files say (``read_ids``)."""
    spark = docs.sparkSession
    return read_ids(spark, write_ids(docs, vocabulary, scratch_path(spark, "ids"), end, file_ids))
