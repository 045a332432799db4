"""Catalogue of tables: entries, themes, descriptions, search and reports."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, fold_name, folded_literal

OTHER_THEME = "outros"  # fixed value: theme of a table that no rule names


def longest_prefix(name: Column, rules: Mapping[str, str], default: str) -> Column:
    """Value of the longest prefix that matches. The rules are configuration, so they become one CASE."""
    out = F.lit(default)
    for prefix in sorted(rules, key=lambda p: (len(p), p)):
        out = F.when(F.startswith(name, F.lit(prefix)), rules[prefix]).otherwise(out)
    return out


def source_of(name: Column, rules: Mapping[str, str]) -> Column:
    first = F.split_part(name, F.lit("_"), F.lit(1))
    out = F.upper(first)
    for word, label in rules.items():
        out = F.when(first == word, label).otherwise(out)
    return out


def first_filled(*choices: Column) -> Column:
    """First non-blank choice: manual before generated before default."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in choices], F.lit(""))


def looked_up(name: Column, values: Mapping[str, str]) -> Column:
    """Configured text for a name, empty when there is none."""
    out = F.lit("")
    for key, text in values.items():
        out = F.when(name == key, text).otherwise(out)
    return out


def entry(df: DataFrame, name: str, time_column: str | None = None, descriptions: Mapping[str, str] | None = None) -> DataFrame:
    """One catalogue row per table. Count and period come from one aggregate that reads one column."""
    texts = descriptions or {}
    columns = F.array(*[
        F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(texts.get(f.name, "")).alias("description"))
        for f in df.schema.fields
    ])
    when = F.col(time_column) if time_column else F.lit(None).cast("timestamp_ntz")

    def shown(c: str) -> Column:  # formatted once, not for every row
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)

    return df.agg(
        F.count("*").alias("row_count"), F.min(when).alias("first"), F.max(when).alias("last"),
    ).select(F.lit(name).alias("name"), F.lit(time_column).cast("string").alias("time_column"), "row_count", shown("first"), shown("last"), columns.alias("columns"))


def build(
    entries: Sequence[DataFrame],
    themes: Mapping[str, str],
    sources: Mapping[str, str],
    manual: Mapping[str, str] | None = None,
    generated: Mapping[str, str] | None = None,
) -> DataFrame:
    """All entries with theme, source and description; hand-written texts go before generated ones."""
    all_entries = reduce(lambda a, b: a.unionByName(b), entries)
    text = first_filled(looked_up(F.col("name"), manual or {}), looked_up(F.col("name"), generated or {}))
    all_entries = all_entries.withColumn("description", text)
    return all_entries.withColumn("theme", longest_prefix(F.col("name"), themes, OTHER_THEME)).withColumn(
        "source", source_of(F.col("name"), sources)
    )


def search(entries: DataFrame, words: str, target: Column, theme: Column | None = None, wanted_theme: str = "") -> DataFrame:
    """Entries whose folded target holds every folded word, with equal theme if one is asked for."""
    folded = fold(target)
    out = entries
    hits = [F.contains(folded, F.lit(w)) for w in folded_literal(words).split()]
    if hits:
        out = out.filter(reduce(lambda a, b: a & b, hits))
    if wanted_theme:
        out = out.filter(fold_name(theme) == folded_literal(wanted_theme))
    return out


def describe(df: DataFrame, descriptions: Mapping[str, str]) -> DataFrame:
    """One row per column: type, description, filled values and range, from a single pass."""
    aggs, rows = [], []
    for i, f in enumerate(df.schema.fields):
        kind = f.dataType.simpleString()
        aggs += [F.count(f.name).alias(f"n{i}"), F.min(f.name).alias(f"a{i}"), F.max(f.name).alias(f"z{i}")]
        low, high = (
            F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kind.startswith("timestamp") else F.col(c).cast("string") for c in (f"a{i}", f"z{i}")
        )
        rows.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(kind).alias("type"), F.lit(descriptions.get(f.name, "")).alias("description"),
            F.col(f"n{i}").alias("filled"), low.alias("lowest"), high.alias("highest"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def with_descriptions(columns: DataFrame, dictionary: DataFrame, key: str = "column", code: str = "codigo", text: str = "descricao") -> DataFrame:
    """Descriptions by normalised column name; columns without one get an empty text."""
    def norm(c: str) -> Column:
        return F.trim(F.regexp_replace(fold_name(F.col(c)), "[^a-z0-9]+", "_"), F.lit("_"))

    texts = dictionary.groupBy(norm(code).alias("k__")).agg(F.min(text).alias("description"))
    return columns.withColumn("k__", norm(key)).join(texts, "k__", "left").drop("k__").fillna("", ["description"])


def undescribed(columns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns and how many lack a description, with one sample each."""
    blank = F.trim("description") == ""
    return columns.groupBy(*keys).agg(
        F.count("*").alias("columns"), F.count_if(blank).alias("undescribed"), F.min(F.when(blank, F.col("column"))).alias("example"),
    )


def totals_by(df: DataFrame, key: Column, size: str, label: str = "source") -> DataFrame:
    """Count and sum per key with a grand total row."""
    return df.withColumn(label, key).rollup(label).agg(
        F.count("*").alias("tables"), F.sum(size).alias("rows"), F.grouping(label).alias("g__")
    ).withColumn(label, F.when(F.col("g__") == 1, "TOTAL").otherwise(F.col(label))).drop("g__")


def limited(df: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows, each flagged if more rows were there. One row more than asked for is read."""
    probe = df.limit(n + 1)  # an ORDER BY below becomes a top-k
    more = probe.agg(F.count("*") > n)
    return probe.limit(n).withColumn("truncated", more.scalar())


MAX_ROWS = 200


def read_only(spark: SparkSession, sql: str) -> DataFrame:
    """One SELECT or WITH as a lazy frame.

    The statement is parsed as a subquery, where commands, inserts and a second statement are syntax
    errors; literals such as 'set' do no harm. Its parsed plan may read registered views and its own named
    subqueries only (no files by path, no other catalogue), and must not call into the JVM's classes.
    """
    statement = sql.strip().rstrip(";").strip()
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(f"SELECT * FROM (\n{statement}\n) AS q").toString()
    known = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    known |= {n.strip().lower() for found in re.findall(r"CTE \[([^\]]*)\]", plan) for n in found.split(",")}
    for found in re.findall(r"UnresolvedRelation \[([^\]]*)\]", plan):
        if found.lower() not in known:
            raise ValueError(f"{found} is no registered view")
    if called := re.search(r"\b(java_method|reflect|try_reflect)\b", plan, re.I):
        raise ValueError(f"{called[1]} is not allowed")
    if re.search(r"UnresolvedTableValuedFunction|UnresolvedIdentifier|PlanWithUnresolvedIdentifier", plan):
        raise ValueError("table functions and computed names are not allowed")
    return spark.sql(f"SELECT * FROM (\n{statement}\n) AS q")


def answer(spark: SparkSession, sql: str, rows: int = MAX_ROWS) -> tuple[list[str], list[tuple], bool]:
    """Column names, at most ``rows`` rows, and whether there were more."""
    df = read_only(spark, sql)
    found = [tuple(r) for r in df.limit(rows + 1).collect()]
    return df.columns, found[:rows], len(found) > rows
