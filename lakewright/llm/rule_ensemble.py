"""Quality scores from a sparse ensemble of rules over text statistics.

Shallow trees are grown on a bounded sample of labelled documents; every path from a root is a rule, a conjunction of
thresholds. A lasso logistic regression over all rules keeps few of them. The rest become one Spark column expression,
so scoring is a projection over whole texts with no model at hand.

The sample is the only bound: at most ``sample`` labelled rows, those with the smallest hash of their id.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, store

SPACE = r"[\x20\x09-\x0D]+"
SAMPLE = 20_000  #: labelled rows to learn from, at most


def statistics() -> dict[str, Column]:
    """Statistics of the column ``text``; all 0 for null, empty and wordless texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chars = F.length(text)

    def share(part: Column, of: Column) -> Column:
        return F.when(of > 0, part / of).otherwise(F.lit(0.0))

    def without(marks: str) -> Column:
        return chars - F.length(F.translate(text, marks, ""))

    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def of_words(h: Column) -> Column:
        return F.struct(
            F.size(h).cast("double").alias("n_words"),
            share(F.size(F.array_distinct(h)), F.size(h)).alias("distinct_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    n_words = F.col("_w.n_words")
    return {
        "_w": let(hashed, of_words),
        "n_words": n_words, "distinct_words": F.col("_w.distinct_words"),
        "chars_per_word": share(chars, n_words), "symbols": share(without("#*$%&|<>"), n_words),
        "marks": share(without(".,;:!?"), n_words), "exclaims": share(without("!"), n_words),
        "digits": share(without("0123456789"), chars),
        "capitals": share(F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")), chars),
        "lines": share(F.size(lines).cast("double"), n_words),
        "distinct_lines": let(lines, lambda x: share(F.size(F.array_distinct(x)), F.size(x))),
        "links": share(without("/@{}[]=_"), n_words),
    }


FEATURES = [
    "n_words", "distinct_words", "chars_per_word", "symbols", "marks", "exclaims", "digits", "capitals", "lines",
    "distinct_lines", "links",
]


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and one struct ``s`` with the statistics of its text."""
    columns = statistics()
    out = docs.select(*keep, "text").withColumn("_w", columns.pop("_w"))
    return out.withColumn("s", F.struct(*[c.cast("double").alias(k) for k, c in columns.items()])).select(*keep, "s")


Rule = tuple[tuple[str, str, float], ...]


def tree_rules(debug: str, names: list[str]) -> set[Rule]:
    """Conditions (statistic, ``<=`` or ``>``, threshold) on the way to every node but the root, from a tree's text form."""
    path: list[tuple[str, str, float]] = []
    rules: set[Rule] = set()
    for line in debug.split("\n"):
        found = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if found:
            one = (names[int(found[3])], found[4], float(found[5]))
            path = [(d, c) for d, c in path if d < len(found[1])] + [(len(found[1]), one)]
            rules.add(tuple(sorted({c for _, c in path})))
    return rules


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, sign, edge in rule:
        value = F.col(f"s.{name}")
        out = out & (value <= edge if sign == "<=" else value > edge)
    return out


def learn(examples: DataFrame, trees: int = 20, depth: int = 3, penalty: float = 0.001) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules from ``examples`` (s, label 0.0 or 1.0); without two labels there is just an intercept."""
    examples = store(examples.select("s", "label"), "examples")
    seen = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    if len(seen) < 2:
        return (4.0 if 1.0 in seen else -4.0 if 0.0 in seen else 0.0), []
    flat = examples.select("label", *[F.col(f"s.{k}").alias(k) for k in FEATURES])
    ready = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(flat).select("label", "x")
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=7, maxBins=64, minInstancesPerNode=10)
    rules = sorted(set().union(*[tree_rules(t.toDebugString, FEATURES) for t in forest.fit(ready).trees]))
    if not rules:
        share = seen[1.0] / (seen[0.0] + seen[1.0])
        return float(4 if share > 0.5 else -4), []
    held = examples.select("label", *[condition(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(held).select("label", "x")
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False)
    model = lasso.fit(held)
    weights = model.coefficients.toArray()
    return float(model.intercept), [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6]


def compiled(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The score, a number between 0 and 1, as an expression over the struct ``s``."""
    total = F.lit(intercept)
    for rule, weight in rules:
        total = total + F.when(condition(rule), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def held_out(doc: Column) -> Column:
    return F.crc32(doc.cast("string").cast("binary")) % 3 == 1


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Learns ``labels.quality`` (0 or 1; of several for one doc_id, the smallest) from rows whose crc32 of the doc_id's text
    modulo 3 is not 1, whole texts, at most ``sample`` of them. Inputs are ``statistics`` of the text and nothing else.
    Null and empty texts get a score like any other. Rows without doc_id are scored; their held_out is false.
    """
    doc = F.col("doc_id").cast("long")
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(doc.alias("_doc")).agg(F.min("quality").cast("double").alias("label"))
    known = known.where(~held_out(F.col("_doc"))).orderBy(F.xxhash64("_doc"), "_doc").limit(sample)
    known = F.broadcast(known)  # at most `sample` rows of two numbers
    base = docs.select(doc.alias("doc_id"), "text")
    examples = measured(base.join(known, F.col("doc_id") == F.col("_doc")), ["label"])
    model = learn(examples, **options)
    out = measured(base, ["doc_id"]).withColumn("score", compiled(*model))
    return out.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
