"""Regular time grid and simple baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import shift_values

DAY_MINUTES = 24 * 60


def slot_totals(df: DataFrame, ts: str, value: str, minutes: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Tumbling totals per slot; values are pre-summed on the map side."""
    slot = F.window(F.col(ts), f"{minutes} minutes").start.cast("timestamp_ntz")
    return df.groupBy(*keys, slot.alias("slot")).agg(F.round(F.sum(value), 2).alias("actual"))


def fill_grid(totals: DataFrame, minutes: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Every slot between the first and last of a series; missing slots count as zero.

    The empty slots are generated from each series' own first and last slot, so there is no cross join,
    and a union with one aggregation replaces the usual left join.
    """
    # looking at the total as well keeps both branches on the same aggregate, so events are scanned once
    filled = F.when(F.col("actual").isNotNull(), F.col("slot"))
    span = totals.groupBy(*keys).agg(F.min(filled).alias("a__"), F.max(filled).alias("z__"))
    grid = span.select(
        *keys,
        F.explode(F.expr(f"sequence(a__, z__, interval {minutes} minutes)")).alias("slot"),
        F.lit(0.0).alias("actual"),
    )
    return totals.unionByName(grid).groupBy(*keys, "slot").agg(F.sum("actual").alias("actual"))


def _later(axis: str, minutes: int) -> Column:
    return F.expr(f"{axis} + interval {minutes} minutes")


def baselines(grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds d1, d2, d7 (same slot 1, 2, 7 days before), d1_real, model and climatology.

    ``d1_real`` is what is known at noon of the day before: mornings from one day back, afternoons from
    two. ``model`` is the mean of the same slot over the seven days before.
    """
    shifts = {f"d{d}": (d, _later("slot", d * DAY_MINUTES)) for d in range(1, 8)}
    wide = shift_values(grid, keys, "slot", "actual", shifts)
    days = [F.col(f"d{d}") for d in range(1, 8)]
    known = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in days), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in days), F.lit(0.0))
    wide = wide.select(
        *keys, "slot", "actual", "d1", "d2", "d7",
        F.when(F.hour("slot") < 12, F.col("d1")).otherwise(F.col("d2")).alias("d1_real"),
        F.round(F.when(known > 0, total / known), 6).alias("model"),
    )
    # one group holds the same slot of one week only, so this window stays small however hot a series is
    same = Window.partitionBy(*keys, "month", "week", "slot_of_day")
    return (
        with_calendar(wide)
        .withColumn("climatology", F.round(F.avg("actual").over(same), 6))
        .drop("month", "week", "slot_of_day")
    )


def with_calendar(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.month("slot").cast("long").alias("month"),
        F.weekofyear("slot").cast("long").alias("week"),
        (F.hour("slot") * 60 + F.minute("slot")).cast("long").alias("slot_of_day"),
    )


def climatology(grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Historical mean by month, ISO week and slot of the day."""
    return (
        with_calendar(grid)
        .groupBy(*keys, "month", "week", "slot_of_day")
        .agg(F.round(F.avg("actual"), 6).alias("climatology"))
    )


METHODS = {
    "model": "model",
    "climatology": "climatology",
    "persistence_d1": "d1",
    "persistence_real": "d1_real",
    "weekly_d7": "d7",
}


def stack_methods(wide: DataFrame, methods: dict[str, str] = METHODS, common_support: bool = True) -> DataFrame:
    """One row per slot and method. With common support, only slots that have a value a week before."""
    base = wide.filter(F.col("d7").isNotNull()) if common_support else wide
    pairs = [F.struct(F.lit(m).alias("method"), F.col(c).alias("pred")) for m, c in methods.items()]
    return base.select("slot", "actual", F.inline(F.array(*pairs)))
