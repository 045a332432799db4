"""Token ids of whole texts by a byte-level BPE vocabulary of the tokenizers library.

Texts are cut where that vocabulary's splitting pattern always cuts: before a single space between two other characters
and before a single newline between two others. So the ids of a text are the ids of its chunks, one behind the other,
and chunks that were met before are looked up. Texts with other white space are cut before single spaces only.
"""

from __future__ import annotations

import os
import re

import numpy as np

MEMO = 1_000_000  #: chunks that a worker remembers; the rest are encoded again when they come again

_GAP = re.compile(r"(?<=\S) (?=\S)")
_KEPT: dict[int, "Encoder"] = {}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.memo: dict[str, bytes] = {}

    @classmethod
    def of(cls, vocabulary: str) -> Encoder:
        """One encoder for each vocabulary and worker, kept between tasks."""
        key = hash(vocabulary)
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = cls(vocabulary)
        return _KEPT[key]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Parts of a text: each stands behind a space of the text, or starts with its own newline or space."""
        flat = text.replace("\n", " \n")
        if " ".join(text.split()) == text.replace("\n", " "):  # only single spaces and newlines, inside
            found = flat.split(" ")
        else:
            found = _GAP.split(text)
        found[0] = f" {found[0]}"
        return found

    def _library(self, chunks: list[str]) -> dict[str, bytes]:
        out = {}
        for lo in range(0, len(chunks), 8192):
            some = chunks[lo : lo + 8192]
            whole = [c[1:] if c[0] == " " else c if c[0] == "\n" else f" {c}" for c in some]
            for c, e in zip(some, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)):
                out[c] = np.array(e.ids, "<u4").tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        get, docs, missing = self.memo.get, [], set()
        for text in texts:
            chunks = self.chunks(text) if text else []
            parts = list(map(get, chunks))
            if None in parts:
                missing.update([c for c, p in zip(chunks, parts) if p is None])
            else:
                chunks = None
            docs.append((chunks, parts))
        found = self._library(list(missing))
        out = [b"".join(p if c is None else [found[k] if v is None else v for k, v in zip(c, p)]) for c, p in docs]
        for c in list(found)[: max(0, MEMO - len(self.memo))]:
            self.memo[c] = found[c]
        return out
