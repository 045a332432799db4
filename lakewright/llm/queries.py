"""The dealt operators over the given tables, with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from . import hash_forest, host_rules, language_id, line_dedup, ngram_join, packing, pieces, repair, rule_ensemble, sharding, simple8b, span_dedup, trie
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(configure(spark), folder)

        run.__doc__, run.__name__ = fn.__doc__, name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


def vocabulary(name: str, binary: bool = False):
    """A public tokenizer's file, read on the driver and sent to the tasks by the operators."""
    from public_tokenizers import path

    with open(path(name), "rb" if binary else "r", **({} if binary else {"encoding": "utf-8"})) as file:
        return file.read()


@query("op1_ngram_join")
def op1(spark, folder):
    return ngram_join.linked_documents(documents(spark, folder), size=4, percent=85)


@query("op2_host_rules", host_rules.SQL)
def op2(spark, folder):
    return host_rules.judged(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op3_line_dedup")
def op3(spark, folder):
    return line_dedup.dedup_lines(documents(spark, folder), size=1, least=1, counts=True).select("doc_id", "n_lines", "n_removed", "text")


@query("op4_hash_forest")
def op4(spark, folder):
    vectors = hash_forest.usable(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return hash_forest.nearest(vectors, vectors.where("id % 20 = 0"), k=20)


@query("op5_span_dedup")
def op5(spark, folder):
    return span_dedup.dedup_spans(documents(spark, folder), counts=True, ends=True, by_content=True).select("doc_id", "n_removed", "text")


@query("op6_bin_slack")
def op6(spark, folder):
    return packing.pack(documents(spark, folder), vocabulary("byte_bpe_50k.json"), room=2048, end=0)


@query("op7_rule_ensemble")
def op7(spark, folder):
    return rule_ensemble.scored(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query("op8_simple8b")
def op8(spark, folder):
    return simple8b.round_trip(documents(spark, folder), vocabulary("byte_bpe_50k.json"), end=2)


@query("op9_pieces")
def op9(spark, folder):
    return pieces.digests(documents(spark, folder), vocabulary("piece_bpe_32k.model", binary=True))


@query("op10_differencing")
def op10(spark, folder):
    return sharding.balanced(documents(spark, folder), shards=16)


@query("op11_repair")
def op11(spark, folder):
    return repair.damage_report(spark.read.parquet(f"{folder}/conversations.parquet"))


@query("op12_centroid_trie", trie.SQL)
def op12(spark, folder):
    return trie.rebuilt_trie(spark.read.parquet(f"{folder}/conversations.parquet"))


@query("op13_language_id")
def op13(spark, folder):
    return language_id.predicted(documents(spark, folder))
