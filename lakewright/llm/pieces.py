"""Exact merge-type encoding with a sentencepiece BPE model, by backtracking over longest matches.

A sequence of pieces is what the merges give if each two neighbours are compatible: merging their joined text gives just
these two. So the longest piece at a place is tried first (Aho-Corasick over the vocabulary); if it does not go with the
piece before it, or ends at a place known to fail, the next shorter one; if none is left, the place is marked in a bit
field and the last piece is taken back. Compatibility is found by re-merging and remembered.

Pieces never reach over the start of a word, so words are encoded one by one and remembered. Characters of no piece
become bytes. Runs of spaces, whose pieces all have the lowest score, are merged from the left after their word.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

SPACE = "▁"
MEMO = 500_000  #: words that a worker remembers
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_KEPT: dict[bytes, "Pieces"] = {}


class Pieces:
    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        p = self.library
        count = p.get_piece_size()
        special = [i for i in range(count) if p.is_control(i) or p.is_unknown(i) or p.is_byte(i)]
        names = p.id_to_piece(list(range(count)))
        self.ids = {names[i]: i for i in set(range(count)).difference(special)}
        self.score = {name: p.get_score(i) for name, i in self.ids.items()}
        self.bytes = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.alphabet = {c for name in self.ids for c in name}
        self.find = ahocorasick.Automaton()
        for name in self.ids:
            self.find.add_word(name, name)
        self.find.make_automaton()
        inner = [n for n in self.ids if SPACE in n.lstrip(SPACE)]
        runs = [n for n in self.ids if n.startswith(SPACE * 2)]
        low = min((s for n, s in self.score.items() if n not in runs and len(n) > 1), default=0)
        if inner or any(n.strip(SPACE) or self.score[n] >= low for n in runs) or not self.alphabet <= set(self.ids):
            raise ValueError("a model with pieces over word starts, or characters that are no pieces, is not supported")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, str] = {}
        self.memo: dict[str, bytes] = {}

    @classmethod
    def of(cls, model: bytes) -> Pieces:
        """One encoder for each model and worker, kept between tasks."""
        if model not in _KEPT:
            _KEPT.clear()
            _KEPT[model] = cls(model)
        return _KEPT[model]

    def merged(self, text: str) -> list[str]:
        """Pieces by merging: always the pair with the best score, of equal ones the leftmost."""
        part: list[str | None] = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(part):
                joined = part[i] + part[j]
                if joined in self.score:
                    heapq.heappush(heap, (-self.score[joined], i, j, joined))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if part[i] is None or part[j] is None or after[i] != j or part[i] + part[j] != joined:
                continue
            part[i], part[j] = joined, None
            after[i] = after[j]
            if after[j] < len(part):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for x in part if x is not None]

    def compatible(self, a: str, b: str) -> bool:
        """Merging gives a, then b; with an empty a, it gives b alone."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= 2 * MEMO:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def _next(self, piece: str) -> str:
        """The longest piece that a piece starts with, other than itself; empty if there is none."""
        known = self.shorter.get(piece)
        if known is None:
            cut = len(piece) - 1
            while cut and piece[:cut] not in self.ids:
                cut -= 1
            known = self.shorter[piece] = piece[:cut]
        return known

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text of known characters without runs of spaces."""
        n = len(text)
        longest = [""] * n
        for end, name in self.find.iter(text):
            at = end - len(name) + 1
            if len(name) > len(longest[at]):
                longest[at] = name
        out, pos, piece, failed = [""], 0, longest[0], 0
        pairs, compatible = self.pairs, self.compatible
        while True:
            end = pos + len(piece)
            if not failed >> end & 1:
                good = pairs.get((out[-1], piece))
                if compatible(out[-1], piece) if good is None else good:
                    out.append(piece)
                    pos = end
                    if pos == n:
                        return out[1:]
                    piece = longest[pos]
                    continue
            piece = self._next(piece)
            while not piece:
                failed |= 1 << pos
                last = out.pop()
                pos -= len(last)
                piece = self._next(last)

    def segment(self, text: str) -> bytes:
        """Ids of a run of spaces and the characters behind it, as little-endian unsigned 32-bit bytes."""
        ids: list[int] = []
        word = text.lstrip(SPACE)
        run = len(text) - len(word)
        if run > 1:
            head = self._known(SPACE + word)
            alone = head[0] == SPACE
            ids += [self.ids[x] for x in self.merged(SPACE * (run if alone else run - 1))]
            rest = head[1:] if alone else head
        else:
            rest = self._known(text)
        for x in rest:
            known = self.ids.get(x)
            ids += [self.bytes[b] for b in x.encode()] if known is None else [known]
        return np.array(ids, "<u4").tobytes()

    def _known(self, text: str) -> list[str]:
        """Pieces and, between them, characters of no piece."""
        if self.alphabet.issuperset(text):
            return self.backtrack(text)
        out, lo = [], 0
        for i, c in enumerate(text):
            if c not in self.alphabet:
                if lo < i:
                    out += self.backtrack(text[lo:i])
                out.append(c)
                lo = i + 1
        return out + (self.backtrack(text[lo:]) if lo < len(text) else [])

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        chunks = text.replace("\n", " \n").split(" ")
        if "" in chunks or SPACE in text:
            chunks = _SEGMENT.findall(SPACE + text.replace(" ", SPACE))
            return b"".join([self.segment(c) for c in chunks])
        memo = self.memo
        parts = list(map(memo.get, chunks))
        if None in parts:
            for i, p in enumerate(parts):
                if p is None:
                    c = chunks[i]
                    parts[i] = self.segment(c if c[0] == "\n" else SPACE + c)
                    if len(memo) < MEMO:
                        memo[c] = parts[i]
        return b"".join(parts)


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text; null and empty texts have no ids.

    The digests are of the decimal ids joined by commas and of the library's ``decode(ids)`` in UTF-8. Every row gives
    one row, also repeated ones and ones without doc_id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        pieces = Pieces.of(shared.value)
        decode, names = pieces.library.decode, [str(i) for i in range(pieces.library.get_piece_size())]
        for batch in batches:
            for part in W.slices(batch):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.frombuffer(pieces.encode(text), "<u4").tolist()
                    joined = ",".join([names[i] for i in ids])
                    back = decode(ids) if ids else ""
                    rows.append((doc, len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
