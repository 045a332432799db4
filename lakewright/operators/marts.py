"""Curtailment fact and marts, keyed joins, radius and validity joins."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import exact_sum, join_keys, percentile_interpolated, round_half_up

# Trusted wind readings, grid step in degrees, Earth radius in metres.
MAX_WIND = 40
CELL = 0.25
EARTH_RADIUS = 6_371_000.0


def curtailment(df: DataFrame, generated: str, reference: str, reason: str, hours: float = 0.5) -> DataFrame:
    """Adds restricted, cut_mw (zero when unrestricted) and cut_mwh."""
    restricted = F.col(reason).isNotNull()
    cut = F.when(restricted, F.greatest(F.col(reference) - F.col(generated), F.lit(0.0))).otherwise(0.0)
    return df.withColumn("restricted", restricted).withColumn("cut_mw", cut).withColumn("cut_mwh", F.col("cut_mw") * hours)


def reliable_wind(flag_ok: Column, speed: Column) -> Column:
    return flag_ok & (speed > 0) & (speed <= MAX_WIND)


def monthly_mart(fact: DataFrame, ts: str, dims: Sequence[str], plant: str, generated: str, hours: float = 0.5) -> DataFrame:
    """Slots, plants, energy cut and generated by month and dimensions."""
    return fact.groupBy(F.date_format(ts, "yyyy-MM").alias("month"), *dims).agg(
        F.count("*").alias("slots"), F.count_distinct(plant).alias("plants"),
        F.round(exact_sum(F.col("cut_mwh")), 6).alias("mwh_cut"), F.round(exact_sum(F.col(generated) * hours), 6).alias("mwh_generated"),
    )


def element_mart(fact: DataFrame, element: str, ts: str, plant: str) -> DataFrame:
    """First and last restricted slot, active days, plants and energy cut per limiting element."""
    totals = fact.filter("restricted").groupBy(element).agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.count_distinct(F.to_date(ts)).alias("active_days"),
        F.count_distinct(plant).alias("plants"), F.round(exact_sum(F.col("cut_mwh")), 6).alias("mwh_cut"),
    )
    return totals.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first", "last")})


def noise_floor(fact: DataFrame, keys: Sequence[str], generated: str, reference: str, hours: float = 0.5) -> DataFrame:
    """Bias of the reference where nothing was restricted: share above, relative error, phantom energy."""
    free = fact.filter("not restricted")
    gap = F.col(reference) - F.col(generated)
    relative = F.round(F.try_divide(F.abs(gap), F.col(generated)), 6)
    shares = free.groupBy(*keys).agg(
        F.count("*").alias("free_slots"), F.round(F.count_if(gap > 0) / F.count("*"), 6).alias("share_above"),
        F.round(exact_sum(F.greatest(gap, F.lit(0.0))) * hours, 6).alias("phantom_mwh"),
    )
    marks = percentile_interpolated(free.select(*keys, relative.alias("e")), keys, "e", {"error_p50": 0.5, "error_p90": 0.9})
    marks = marks.select(*keys, round_half_up(F.col("error_p50"), 6).alias("error_p50"), round_half_up(F.col("error_p90"), 6).alias("error_p90"))
    return join_keys(shares, marks, keys, "left")


def cell_of(degrees: Column, step: float = CELL) -> Column:
    return F.round(degrees / step) * step + F.lit(0.0)  # -0.0 and 0.0 are the same cell


def cells_summary(plants: DataFrame, lat: str, lon: str, state: str, kind: str, wind: str, capacity: str) -> DataFrame:
    """Plants and capacity per grid cell, largest capacity first."""
    return plants.groupBy(lat, lon).agg(
        F.min(state).alias("state"), F.count_if(F.col(kind) == wind).alias("wind"), F.count_if(F.col(kind) != wind).alias("other"),
        F.round(F.sum(capacity), 1).alias("capacity"),
    ).orderBy(F.col("capacity").desc(), lat, lon)


RADIX, LEVELS = 64, 4  #: blocks of 1, 64, 64^2 and 64^3 days reach over all dates
FIRST_DAY = 719_528  #: days before 1970 from which days are counted, so that they are not negative


def _span(lo: Column, hi: Column) -> Column:
    """lo, lo + 1, ... below hi; empty when there is none."""
    return F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))


def _block(level: int, b: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), b.alias("block"))


def aligned_blocks(first: Column, until: Column) -> Column:
    """Days from ``first`` to before ``until`` as the fewest aligned blocks: an array of (level, block)."""
    parts = []
    for level in range(LEVELS):
        width = RADIX**level
        lo, hi = F.ceil(first / width).cast("long"), F.floor(until / width).cast("long")
        if level == LEVELS - 1:
            blocks = _span(lo, hi)
        else:  # blocks of the next level take the middle
            nlo, nhi = F.ceil(lo / RADIX).cast("long") * RADIX, F.floor(hi / RADIX).cast("long") * RADIX
            blocks = F.when(nlo >= nhi, _span(lo, hi)).otherwise(F.concat(_span(lo, nlo), _span(nhi, hi)))
        parts.append(F.transform(blocks, partial(_block, level)))
    return F.concat(*parts)


CLOSED = [4**k for k in range(13)]  #: widths in days of the blocks that closed relations are written to


def _blocks(first: Column, until: Column) -> Column:
    """(level, block) rows of the days from ``first`` to before ``until``; a null ``until`` is open. Levels count ``CLOSED``.

    A closed relation is written to the one or two blocks, no shorter than it is, that it touches. An open one is the fewest
    aligned blocks of 64 days and more, at most 189; every third level is one of these.
    """
    length = until - first
    level = F.coalesce(*[F.when(length <= width, F.lit(k)) for k, width in enumerate(CLOSED)], F.lit(len(CLOSED) - 1))
    width = F.element_at(F.array(*[F.lit(w) for w in CLOSED]), level + 1)
    touched = F.sequence(F.floor(first / width).cast("long"), F.floor((until - 1) / width).cast("long"))
    closed = F.transform(touched, lambda b: F.struct(level.alias("level"), b.alias("block")))
    coarse = aligned_blocks(F.floor(first / RADIX).cast("long"), F.lit(RADIX ** (LEVELS - 1)).cast("long"))
    opened = F.transform(coarse, lambda b: F.struct((3 * (b.level + 1)).alias("level"), b.block.alias("block")))
    return F.when(until.isNull(), opened).otherwise(closed)


LIGHT = 64  #: relations of a key that each fact of the key may be held against
FLAGS = 500_000  #: keys with more relations than that, which may be broadcast after they were counted


def validity_join(facts: DataFrame, relation: DataFrame, key: str, ts: str, start: str, end: str) -> DataFrame:
    """Facts with the relations that were valid at their time (start included, end not); a null end is still valid.

    Facts of a key with at most ``LIGHT`` relations meet all of them, so neither side is multiplied. A relation of another key
    is written as a few blocks of days (``_blocks``), and a fact looks up one block of each size that some relation has, at
    most 13; the two meet in at most one block. Times decide in both. The facts are read once, and no latest time is needed;
    relations are read again to be counted. Exploded rows stand behind Spark's estimate, so the join is told not to
    broadcast. Null keys and starts, and ends not after their start, join with nothing.
    """
    def day(c: Column) -> Column:
        return F.unix_date(F.to_date(c)).cast("long") + FIRST_DAY

    usable = F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start)))
    relation = relation.filter(usable)
    heavy = materialize(relation.groupBy(F.col(key).alias("h__")).agg(F.count("*").alias("n__")).filter(F.col("n__") > LIGHT).select("h__"), "heavy-keys")
    many, whole = heavy.count(), F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("block")))

    def placed(df: DataFrame, blocks) -> DataFrame:
        if not many:
            return df.withColumns({"l__": F.lit(-1), "k__": F.lit(0).cast("long")})
        marked = df.join(F.broadcast(heavy) if many <= FLAGS else heavy, F.col(key) == F.col("h__"), "left")
        spread = marked.withColumn("b__", F.explode(F.when(F.col("h__").isNull(), whole).otherwise(blocks())))
        return spread.withColumns({"l__": F.col("b__.level"), "k__": F.col("b__.block")}).drop("b__", "h__")

    rel = placed(relation, lambda: _blocks(day(F.col(start)), day(F.col(end)) + 1))
    used = sorted(x.l__ for x in rel.filter("l__ >= 0").select("l__").distinct().collect()) if many else []  # at most 13 numbers

    def lookups() -> Column:
        return F.array(*[F.struct(F.lit(n).alias("level"), F.floor(day(F.col(ts)) / CLOSED[n]).cast("long").alias("block")) for n in used])

    valid = (F.col(ts) >= F.col(start)) & (F.col(end).isNull() | (F.col(ts) < F.col(end)))
    return placed(facts, lookups).join(rel.hint("merge"), [key, "l__", "k__"]).filter(valid).drop("l__", "k__")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def within_radius(points: DataFrame, targets: DataFrame, metres: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points that lie within a radius of any target, anywhere on the sphere.

    Bands of latitude are as high as the radius. A band is cut into cells as wide as the radius reaches in it, and is one cell
    near a pole. Targets are written into their own and the neighbouring cells of three bands, across the date line too;
    points stay in one cell, so the big side is not multiplied. The semi join stops at the first hit.
    """
    reach = math.degrees(metres / EARTH_RADIUS) * 1.000001 + 1e-9
    bands = max(math.floor(180 / reach), 1) if reach < 180 else 1
    height = 180 / bands

    def band_of(c: Column) -> Column:
        return F.greatest(F.least(F.floor((c + 90) / height), F.lit(bands - 1)), F.lit(0)).cast("long")

    def cells_in(band: Column) -> Column:
        """How many cells a band has: none narrower than what the radius spans at the band's edge nearer a pole."""
        edge = F.greatest(F.abs(band * height - 90), F.abs((band + 1) * height - 90))
        ratio = math.sin(math.radians(min(reach, 90))) / F.cos(F.radians(edge))
        width = F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 1.000001
        return F.when((edge + reach >= 90) | (ratio >= 1), F.lit(1)).otherwise(F.greatest(F.floor(360 / width), F.lit(1))).cast("long")

    def cell_in(c: Column, cells: Column) -> Column:
        return F.least(F.floor(F.pmod(c + 180, F.lit(360.0)) / 360 * cells), cells - 1).cast("long")

    t = targets.select(F.col(lat).alias("lat__"), F.col(lon).alias("lon__")).where("lat__ is not null and lon__ is not null").distinct()
    t = t.withColumn("cy__", F.explode(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: band_of(F.col("lat__")) + d))).where(F.col("cy__").between(0, bands - 1))
    t = t.withColumn("n__", cells_in(F.col("cy__"))).withColumn("c__", cell_in(F.col("lon__"), F.col("n__")))
    around = F.array_distinct(F.array(*[F.pmod(F.col("c__") + d, F.col("n__")) for d in (-1, 0, 1)]))
    t = t.select("lat__", "lon__", "cy__", F.explode(around).alias("cx__"))
    p = points.withColumn("cy__", band_of(F.col(lat))).withColumn("cx__", cell_in(F.col(lon), cells_in(F.col("cy__"))))
    same = (p["cy__"] == t["cy__"]) & (p["cx__"] == t["cx__"])
    close = haversine(p[lat], p[lon], t["lat__"], t["lon__"]) <= metres
    return p.join(t, same & close, "left_semi").drop("cy__", "cx__")


def forecast_errors(issues: DataFrame, observed: DataFrame, cell: Sequence[str], valid: str, issued: str) -> DataFrame:
    """Forecasts beside what was observed, by lead time in days."""
    both = issues.join(observed, [*cell, valid])
    return both.withColumn("lead", F.datediff(valid, issued).cast("bigint")).groupBy("lead").agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("forecast") - F.col("observed"))), 6).alias("mae"),
        F.round(F.avg(F.col("forecast") - F.col("observed")), 6).alias("bias"),
    )


def _responses(df: DataFrame, json: str, keep: Sequence[str]) -> DataFrame:
    """One row per response, as a variant ``o__``; the text holds one object or a list of them. Broken texts give none."""
    text = F.trim(F.col(json))
    listed = F.when(F.startswith(text, F.lit("[")), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return df.select(*keep, F.explode(F.try_variant_get(F.try_parse_json(listed), "$", "array<variant>")).alias("o__"))


def hourly_rows(df: DataFrame, json: str, keep: Sequence[str], variables: Sequence[str] = ("value",)) -> DataFrame:
    """Parallel arrays of an hourly response as rows: time and one column per variable; the longest array decides.

    A variable that a response lacks, or whose array ends earlier, is null there.
    """
    def numbers(name: str) -> Column:
        return F.coalesce(F.try_variant_get("o__", f'$.hourly["{name}"]', "array<double>"), F.array().cast("array<double>"))

    times = F.coalesce(F.try_variant_get("o__", "$.hourly.time", "array<string>"), F.array().cast("array<string>"))
    zipped = F.arrays_zip(times.alias("time"), *[numbers(v).alias(v) for v in variables])
    return _responses(df, json, keep).select(*keep, F.inline(zipped).alias("time", *variables))


def hourly_values(df: DataFrame, json: str, keep: Sequence[str]) -> DataFrame:
    """Every variable that a response has, whatever its name: (``keep``, variable, time, value) rows."""
    each = _responses(df, json, keep).select(
        *keep, F.try_variant_get("o__", "$.hourly", "map<string,variant>").alias("h__"),
        F.coalesce(F.try_variant_get("o__", "$.hourly.time", "array<string>"), F.array().cast("array<string>")).alias("t__"),
    )
    listed = each.select(*keep, "t__", F.explode("h__").alias("variable", "v__")).where("variable != 'time'")
    zipped = F.arrays_zip(F.col("t__").alias("time"), F.try_variant_get("v__", "$", "array<double>").alias("value"))
    return listed.select(*keep, "variable", F.inline(zipped).alias("time", "value"))
