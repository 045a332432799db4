"""Many files of one dataset, with drifting schemas, into one typed table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse
from . import schema as rules


@dataclass
class Unified:
    """Typed table with what was learnt about it. ``df`` is lazy; the rest are small driver values."""

    df: DataFrame
    types: dict[str, T.DataType]
    time_column: str | None = None
    rows: int = 0
    null_time_rows: int = 0
    period: tuple | None = None
    files: int = 0

    @property
    def kept(self) -> DataFrame:
        """Rows with a time; all rows of a table without a time column."""
        return self.df.filter(F.col(self.time_column).isNotNull()) if self.time_column else self.df

    @property
    def quarantine(self) -> DataFrame:
        """Rows without a time, which no year holds."""
        return self.df.filter(F.col(self.time_column).isNull()) if self.time_column else self.df.limit(0)


def column_order(parts: Sequence[DataFrame]) -> list[str]:
    """All columns in first-seen order."""
    return list(dict.fromkeys(c for p in parts for c in p.columns))


def probe_aggs(name: str, c: Column, source: T.DataType, times: bool, numbers: bool) -> list[Column]:
    """Filled values, and failures of the parsers that can decide this column; the others stay zero."""
    t = c.cast("string")
    filled = F.count_if(t.isNotNull() & (F.trim(t) != ""))
    none = F.lit(0).cast("bigint")
    if isinstance(source, rules.TIMES):
        bad_times, bad_numbers = none, filled
    elif isinstance(source, rules.NUMBERS):
        bad_times, bad_numbers = F.count_if(parse.failed(c, parse.timestamp_multi(c))) if times else none, none
    else:
        bad_times = F.count_if(parse.failed(c, parse.timestamp_multi(c))) if times else none
        bad_numbers = F.count_if(parse.failed(c, parse.number_generic(c))) if numbers else none
    return [filled.alias(f"{name}__filled"), bad_times.alias(f"{name}__times"), bad_numbers.alias(f"{name}__numbers")]


def probe(parts: Sequence[DataFrame], columns: Sequence[str]) -> dict[str, tuple[int, int, int]]:
    """(filled, failing as time, failing as number) per column over the full content, in one job."""
    if not columns:
        return {}
    temporal = {c for c in columns for p in parts if c in p.columns and isinstance(p.schema[c].dataType, rules.TIMES)}
    frames = []
    for p in parts:
        have = [c for c in columns if c in p.columns]
        if have:
            frames.append(p.agg(*[
                a for c in have
                for a in probe_aggs(c, F.col(c), p.schema[c].dataType, c in temporal or rules.looks_like_date(c), not rules.is_code(c))
            ]))
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    row = merged.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in merged.columns]).first()
    return {c: (row[f"{c}__filled"], row[f"{c}__times"], row[f"{c}__numbers"]) for c in columns}


def converted(c: Column, source: T.DataType, target: T.DataType) -> Column:
    """Cast that yields null instead of an error, with the locale rules for text."""
    if source == target:
        return c
    if isinstance(target, T.DoubleType):
        return c.try_cast("double") if isinstance(source, rules.NUMBERS) else parse.number_generic(c)
    if isinstance(target, T.TimestampNTZType):
        return c.cast("timestamp_ntz") if isinstance(source, rules.TIMES) else parse.timestamp_multi(c)
    if isinstance(target, T.StringType):
        return parse.blank_to_null(c)
    return c.try_cast(target)


def union_typed(parts: Sequence[DataFrame], types: dict[str, T.DataType]) -> DataFrame:
    """Cast every part first, then union by name; a column a part lacks is a typed null."""
    cast = []
    for p in parts:
        have = {f.name: f.dataType for f in p.schema.fields}
        cast.append(p.select(*[converted(F.col(n), have[n], t).alias(n) for n, t in types.items() if n in have]))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)
    return out.select(*[F.col(n).cast(t).alias(n) for n, t in types.items()])


def merge_by_signature(parts: Sequence[DataFrame]) -> list[DataFrame]:
    """Parts with the same schema become one branch, so the plan grows with variants, not with files."""
    groups: dict[tuple, DataFrame] = {}
    for p in parts:
        key = rules.signature(p)
        groups[key] = groups[key].union(p) if key in groups else p
    return list(groups.values())


def _profile(df: DataFrame, times: Sequence[str], exact: bool) -> dict:
    count_distinct = F.count_distinct if exact else F.approx_count_distinct
    aggs = [F.count("*").alias("rows")]
    for c in times:
        clean = parse.drop_sentinel_dates(F.col(c))
        aggs += [
            F.count_if(~parse.day_only(F.col(c).cast("timestamp_ntz"))).alias(f"{c}__timed"),
            count_distinct(clean).alias(f"{c}__distinct"),
            F.min(clean).alias(f"{c}__min"),
            F.max(clean).alias(f"{c}__max"),
            F.count(clean).alias(f"{c}__filled"),
        ]
    return df.agg(*aggs).first().asDict()


def unify(parts: Sequence[DataFrame], exact: bool = False) -> Unified:
    """Reconcile, cast, union, demote and profile.

    Two small jobs read the data (probe of undecided columns, profile of the union); both look at
    whole columns. The returned frame is still lazy.
    """
    files = len(parts)
    parts = merge_by_signature([rules.normalize_columns(p) for p in parts])
    names = column_order(parts)
    seen = {n: [p.schema[n].dataType for p in parts if n in p.columns] for n in names}
    open_names = [n for n in names if rules.settled_type(seen[n]) is None]
    counts = probe(parts, open_names)
    types = {n: rules.reconciled_type(n, seen[n], *counts.get(n, (0, 0, 0))) for n in names}

    raw = union_typed(parts, types)
    plain_times = [n for n, t in types.items() if isinstance(t, (T.DateType, T.TimestampNTZType))]
    facts = _profile(raw, plain_times, exact)
    final = []
    for n, t in types.items():
        if n not in plain_times:
            final.append(F.col(n))
            continue
        clean = parse.drop_sentinel_dates(F.col(n))
        if isinstance(t, T.TimestampNTZType) and facts[f"{n}__timed"] == 0:
            types[n] = t = T.DateType()
        final.append(clean.cast(t).alias(n))
    df = raw.select(*final)

    candidates = [n for n in plain_times if rules.may_be_time(n)]
    time = max(candidates, key=lambda n: facts[f"{n}__distinct"], default=None)
    out = Unified(df, types, time, facts["rows"], files=files)
    if time:
        out.null_time_rows = facts["rows"] - facts[f"{time}__filled"]
        out.period = (facts[f"{time}__min"], facts[f"{time}__max"])
    return out


def by_convention(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of files whose column names alone fix the types."""
    cast = []
    names = list(dict.fromkeys(c.lower() for p in parts for c in p.columns))
    for p in parts:
        cols = []
        for f in p.schema.fields:
            n, target = f.name.lower(), rules.convention_type(f.name.lower())
            c = F.col(f"`{f.name}`")
            if n == rules.PACKED_DAY_COLUMN:
                value = parse.packed_date(c)
            elif isinstance(target, T.DoubleType) and isinstance(f.dataType, T.StringType):
                value = parse.number_convention(c)
            elif isinstance(target, T.TimestampNTZType) and isinstance(f.dataType, T.StringType):
                value = parse.timestamp_iso(F.trim(c))
            else:
                value = c.try_cast(target)
            cols.append(value.alias(n))
        cast.append(p.select(*cols))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)
    return out.select(*[F.col(n).cast(rules.convention_type(n)).alias(n) for n in names])


def declared(df: DataFrame, numeric: Sequence[str], dates: Sequence[str]) -> DataFrame:
    """Declared numeric and date columns; all else is trimmed text. Names are lower-cased."""
    cols = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        if name in numeric:
            c = parse.number_tariff(c)
        elif name in dates:
            c = parse.timestamp_iso(F.trim(c)).cast("date")
        else:
            c = parse.blank_to_null(c)
        cols.append(c.alias(name.lower()))
    return df.select(*cols)


def drop_empty_rows(df: DataFrame, drop: Sequence[str] = ("dataexcel",)) -> DataFrame:
    """Without a duplicate column and without rows that hold nothing."""
    return df.drop(*drop).na.drop("all")


def trim_strings(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.trim(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ])


# Ranges in which a number is read as a packed day or as a year.
PACKED_DAYS = (19000101, 21001231)
YEARS = (1900, 2100)


def packed_or_year(df: DataFrame, name: str, year_name: str = "ano") -> DataFrame:
    """A column of packed days becomes a date; a column of years is renamed."""
    n = F.col(name).try_cast("bigint")
    low, high, filled = df.agg(F.min(n), F.max(n), F.count(n)).first()
    if filled and PACKED_DAYS[0] <= low and high <= PACKED_DAYS[1]:
        return df.withColumn(name, parse.packed_date(n))
    if filled and YEARS[0] <= low and high <= YEARS[1]:
        return df.withColumnRenamed(name, year_name)
    return df


def described(columns: Sequence[str], known: dict[str, str]) -> dict[str, str]:
    """Old descriptions carried over to a rebuilt table; new columns have none yet."""
    return {c: known.get(c, "") for c in columns}
