"""Quality rules for documents and for the hosts they come from, in DataFrame functions only.

Each text is measured and held against base rules. Failures of these and of softer rules are added up by host (the
``source`` column); a host with few documents says little, so its failure rate is shrunk towards all hosts' rates with a
beta prior whose two parameters are fitted to the hosts by moments. Hosts whose shrunk rate is too high lose all their
documents, the others only those that failed the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _covered(placed: Column) -> Column:
    """Words that repeated windows cover, of windows (hash, place) in order."""
    twice = F.filter(placed, lambda x, i: (F.get(placed, i - 1)["h"] == x["h"]) | (F.get(placed, i + 1)["h"] == x["h"]))
    return F.aggregate(
        F.array_sort(F.transform(twice, lambda x: x["i"])), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")),
    )["n"]


def _repeated_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that are found twice or more in the list."""

    def of_hashes(hashed: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashed) - WINDOW + 1)
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(hashed, i, WINDOW))), of_windows)

    def of_windows(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(windows) == F.size(F.array_distinct(windows)), 0).otherwise(let(placed, _covered))

    return F.when(F.size(words) <= WINDOW, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of the whole text; null: 0.

    Words are runs of characters other than space and ``\\t\\n\\v\\f\\r``. Columns of these names are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words, lines = fresh(docs, "_words"), fresh(docs, "_lines")
    out = docs.withColumn(words, _words(text))
    out = out.withColumn(lines, F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return out.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeated_words(F.col(words)).cast("long"),
    }).drop(words, lines)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_failed() -> Column:
    """Any rule: the base rules, words of an odd mean length, many symbols, many repeated lines."""
    odd_words = (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))
    return base_failed() | odd_words | (10 * F.col("n_symbols") > F.col("n_words")) | (5 * F.col("n_dup_lines") > F.col("n_words"))


def host_verdicts(measured: DataFrame, host: str = "source", reject: float = 0.5) -> DataFrame:
    """(host, n_host, n_failed, host_rate, host_kept), one row per host; documents without a host share one.

    The beta prior has the mean and variance of the hosts' rates over hosts; without a variance between 0 and
    mean * (1 - mean) it is the uniform one. ``host_rate`` is the posterior mean; a host goes if it is over ``reject``.
    """
    hosts = measured.groupBy(F.col(f"`{host}`").alias("host")).agg(
        F.count("*").alias("n_host"), F.count_if(rule_failed()).alias("n_failed")
    )
    rate = F.col("n_failed") / F.col("n_host")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    m, v = F.col("m"), F.col("v")
    fits = (v > 1e-9) & (v < m * (1 - m))
    weight = F.when(fits, m * (1 - m) / v - 1)
    prior = prior.select(F.coalesce(m * weight, F.lit(1.0)).alias("alpha"), F.coalesce((1 - m) * weight, F.lit(1.0)).alias("beta"))
    shrunk = (F.col("n_failed") + F.col("alpha")) / (F.col("n_host") + F.col("alpha") + F.col("beta"))
    joined = hosts.join(F.broadcast(prior), F.col("n_host") >= 0)  # one row of two numbers
    return joined.select("host", "n_host", "n_failed", shrunk.alias("host_rate"), (shrunk <= reject).alias("host_kept"))


def judged(docs: DataFrame, host: str = "source", reject: float = 0.5) -> DataFrame:
    """``docs`` with the measures, base_failed, host_rate and kept. Every row stays, with or without text or host."""
    known, rate, kept = fresh(docs, "_host"), fresh(docs, "_rate"), fresh(docs, "_kept")
    measured = measures(docs)
    verdicts = host_verdicts(measured, host, reject).select(
        F.col("host").alias(known), F.col("host_rate").alias(rate), F.col("host_kept").alias(kept)
    )
    out = measured.join(verdicts, F.col(f"`{host}`").eqNullSafe(F.col(known)))
    return out.withColumns({
        "base_failed": base_failed(), "host_rate": F.col(rate), "kept": ~base_failed() & F.col(kept),
    }).drop(known, rate, kept)


def keep_documents(docs: DataFrame, host: str = "source", reject: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that stay, with just its columns."""
    names = [fresh(docs, "_in") + f"_{i}" for i in range(len(docs.columns))]
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    at = {c.lower(): n for c, n in zip(docs.columns, names)}
    work = renamed.withColumns({"text": F.col(at["text"]), host: F.col(at[host.lower()])})
    return judged(work, host, reject).where("kept").select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])


#: The same in DuckDB's SQL over ``documents``.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
runs AS (SELECT doc_id, i, list_slice(words, i, i + 7) AS run FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n_host, count(*) FILTER (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words
        OR 10 * n_symbols > n_words OR 5 * n_dup_lines > n_words) AS n_failed FROM f GROUP BY source),
p AS (SELECT avg(n_failed / n_host) AS m, var_pop(n_failed / n_host) AS v FROM h),
q AS (SELECT CASE WHEN v > 1e-9 AND v < m * (1 - m) THEN m * (m * (1 - m) / v - 1) ELSE 1.0 END AS a,
             CASE WHEN v > 1e-9 AND v < m * (1 - m) THEN (1 - m) * (m * (1 - m) / v - 1) ELSE 1.0 END AS b FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (n_failed + a) / (n_host + a + b) <= 0.5 AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source CROSS JOIN q
"""
