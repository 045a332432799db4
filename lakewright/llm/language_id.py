"""Language identification in two levels: the family first, then its closely related languages one against one.

Every decision is a linear support vector machine between two classes; a class with the most votes wins, ties go to the
larger sum of margins, then to the smaller name. Features are shares of byte n-grams inside words, 1 to ``LONGEST`` bytes
of the lower-cased text, by hash bucket; only the text is looked at, and all of it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import crc32, store

WIDTH = 2048  #: hash buckets of n-grams
LONGEST = 4  #: bytes of the longest n-gram
PER_LANGUAGE = 1000  #: rows at most of each language that are learned from, those with the smallest hashes of their ids
ROWS = 512  #: rows whose features are held at a time
STEPS = 10  #: of each fit; more did not help on held-out rows
UNKNOWN = "und"

# Families of languages; a language that is not listed is a family of its own.
FAMILIES = {
    "af": "germanic", "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "gl": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "hr": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "sl": "slavic", "sr": "slavic", "uk": "slavic",
}

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def features(column: pa.Array) -> np.ndarray:
    """A row of ``WIDTH`` numbers for every text: square roots of the shares of its n-grams; zeros without letters.

    Bytes beyond ASCII count as letters. An n-gram may begin or end with the space beside a word but never spans one.
    """
    data, offsets = W.text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    n = len(offsets) - 1
    # one space before each text and behind the last, everything else but letters a space, runs of spaces one
    data = np.insert(_LETTERS[data], offsets, np.uint8(32))
    owner = np.append(np.repeat(np.arange(n), np.diff(offsets) + 1), n)
    space = data == 32
    keep = ~space
    keep[0] = True
    keep[1:] |= space[1:] & (~space[:-1] | (owner[1:] != owner[:-1]))
    data, owner, space = data[keep], owner[keep], space[keep]
    counts = np.zeros(n * WIDTH)
    for size in range(1, LONGEST + 1):
        m = len(data) - size + 1
        if m <= 0:
            break
        code, whole = np.full(m, size, np.uint64), np.ones(m, bool) if size > 2 else ~(space[:m] & space[size - 1 :])
        for i in range(size):
            code = code * np.uint64(257) + data[i : i + m]
            if 0 < i < size - 1:
                whole &= ~space[i : i + m]
        at = (W.mix(code[whole]) % np.uint64(WIDTH)).astype(np.int64)
        counts += np.bincount(owner[:m][whole] * WIDTH + at, minlength=n * WIDTH)[: n * WIDTH]
    counts = counts.reshape(n, WIDTH)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def _batches(batches):
    for batch in batches:
        for part in W.slices(batch):
            for lo in range(0, part.num_rows, ROWS):
                yield part.slice(lo, ROWS)


@dataclass
class Level:
    """Machines between every two of ``classes``; a positive margin speaks for the first of the two."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class number of every row and how sure it is (0 to 1)."""
        votes, sums = np.zeros((len(x), len(self.classes))), np.zeros((len(x), len(self.classes)))
        if self.pairs:
            margins = x @ self.weights.T + self.bias
            for k, (a, b) in enumerate(self.pairs):
                votes[:, a] += margins[:, k] > 0
                votes[:, b] += margins[:, k] <= 0
                sums[:, a] += margins[:, k]
                sums[:, b] -= margins[:, k]
        best = np.lexsort((np.arange(len(self.classes))[::-1] + 0 * sums, sums, votes), axis=1)[:, -1]
        rivals = max(len(self.classes) - 1, 1)
        sure = 1 / (1 + np.exp(-np.clip(sums[np.arange(len(x)), best] / rivals, -30, 30))) if self.pairs else np.ones(len(x))
        return best, sure


@dataclass
class Model:
    families: Level
    languages: list[Level]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, score = self.families.decide(x)
        names = np.empty(len(x), object)
        for i, level in enumerate(self.languages):
            rows = np.flatnonzero(family == i)
            found, sure = level.decide(x[rows])
            names[rows] = np.array(level.classes, object)[found]
            score[rows] *= sure
        return names.tolist(), score


def examples(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, x) of at most ``per_language`` rows of every language of ``docs`` (doc_id, text, lang)."""
    # ids' hashes are spread evenly, so of a frequent language only about twice the wanted rows meet to be ranked
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / float(1 << 63)
    counts = docs.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n"))
    few = docs.select("doc_id", "lang", place.alias("_place")).join(F.broadcast(counts), F.col("lang") == F.col("_lang"))  # a row for each language
    few = few.where(F.col("_place") * F.col("_n") < 2 * per_language + 100)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_place", "doc_id"))
    chosen = few.withColumn("_rank", rank).where(F.col("_rank") <= per_language).select("doc_id", "lang")
    chosen = F.broadcast(store(chosen.distinct(), "learned-ids"))  # at most `per_language` rows of each language
    texts = docs.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"])

    def run(batches):
        for part in _batches(batches):
            x = features(part.column("text"))
            ends = np.arange(0, x.size + 1, WIDTH, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], ["lang", "x"])

    return store(texts.select("lang", "text").mapInArrow(run, "lang string, x array<double>"), "language-examples")


def _level(rows: DataFrame, group: str, classes: list[str]) -> Level:
    pairs, weights, bias = list(combinations(range(len(classes)), 2)), [], []
    for a, b in pairs:
        two = rows.where(F.col(group).isin(classes[a], classes[b]))
        two = two.select((F.col(group) == classes[a]).cast("double").alias("label"), array_to_vector("x").alias("features")).coalesce(2)  # the sample is bounded and a step is short
        machine = LinearSVC(maxIter=STEPS, regParam=1e-2, standardization=True).fit(two)
        weights.append(machine.coefficients.toArray())
        bias.append(machine.intercept)
    return Level(classes, pairs, np.array(weights).reshape(len(pairs), WIDTH), np.array(bias))


def learn(rows: DataFrame, families: Mapping[str, str] = FAMILIES) -> Model | None:
    """Machines for the families, and for the languages of each, from ``examples``; None without any."""
    known = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # a handful of names
    if not known:
        return None
    groups: dict[str, list[str]] = {}
    for lang in known:
        groups.setdefault(families.get(lang, lang), []).append(lang)
    family = F.lit(None).cast("string")
    for lang in known:
        family = F.when(F.col("lang") == lang, families.get(lang, lang)).otherwise(family)
    rows = rows.withColumn("family", family)
    names = sorted(groups)
    return Model(_level(rows, "family", names), [_level(rows, "lang", groups[name]) for name in names])


def held_out(doc):
    return F.coalesce(crc32(doc.cast("string")) % 4 == 2, F.lit(False))


def predicted(docs: DataFrame, per_language: int = PER_LANGUAGE, families: Mapping[str, str] = FAMILIES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text, lang; other columns are ignored).

    Learns from rows whose crc32 of the doc_id's text modulo 4 is not 2 and that have a lang, a doc_id and a letter in their
    text, at most ``per_language`` of each language. A null text, or one without a letter, is ``und`` with score 0, as is
    every text where nothing could be learned. A row without doc_id is predicted; its held_out is false. Repeated rows are
    predicted each; long texts are read whole. An empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    model = learn(examples(base.where(~held_out(F.col("doc_id")) & lettered).where("lang is not null and doc_id is not null"), per_language), families)

    def run(batches):
        for part in _batches(batches):
            has, n = part.column("lettered").to_numpy(zero_copy_only=False), part.num_rows
            names, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if model is not None and has.any():
                rows = np.flatnonzero(has)
                names[rows], score[rows] = model.predict(features(part.column("text").take(pa.array(rows))))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    out = base.select("doc_id", "text", lettered.alias("lettered")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
