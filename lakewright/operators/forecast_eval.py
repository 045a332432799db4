"""Forecast scorecards: every method in one pass over the stacked (actual, pred) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeseries import METHODS, stack_methods


def _err() -> Column:
    return F.col("actual") - F.col("pred")


def regression_aggs() -> list[Column]:
    """MAE, RMSE, bias, WAPE, R2, correlation, MAE where something happened.

    The total sum of squares comes from the merged population variance, so R2 needs neither a second
    pass nor a join with the overall mean.
    """
    sse = F.sum(_err() * _err())
    sst = F.var_pop("actual") * F.count("actual")
    return [
        F.avg(F.abs(_err())).alias("mae"),
        F.sqrt(F.avg(_err() * _err())).alias("rmse"),
        F.avg(-_err()).alias("bias"),
        (F.try_divide(F.sum(F.abs(_err())), F.sum("actual")) * 100).alias("wape_pct"),
        (1 - F.try_divide(sse, sst)).alias("r2"),
        F.corr("actual", "pred").alias("corr"),
        F.avg(F.when(F.col("actual") > 0, F.abs(_err()))).alias("mae_pos"),
    ]


def regression(stacked: DataFrame, digits: int = 6) -> DataFrame:
    out = stacked.groupBy("method").agg(*regression_aggs())
    # adding zero turns -0.0 into 0.0
    return out.select("method", *[(F.round(c, digits) + F.lit(0.0)).alias(c) for c in out.columns if c != "method"])


def skill_gain(stacked: DataFrame, model: str = "model", methods: Sequence[str] = tuple(METHODS)) -> DataFrame:
    """MAE reduction of the model against every other method, from MAEs rounded to one decimal."""
    maes = [F.round(F.avg(F.when(F.col("method") == m, F.abs(_err()))), 1).alias(m) for m in methods]
    gains = [
        F.struct(
            F.lit(m).alias("method"),
            F.round((1 - F.try_divide(F.col(model), F.col(m))) * 100, 1).alias("gain_pct"),
        )
        for m in methods if m != model
    ]
    return stacked.agg(*maes).select(F.inline(F.array(*gains)))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def binary_events(stacked: DataFrame, thresholds: Sequence[float], digits: int = 6) -> DataFrame:
    """Confusion counts and rates of "value reaches the threshold", per method and threshold."""
    at = stacked.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    said, was = F.col("pred") >= F.col("threshold"), F.col("actual") >= F.col("threshold")
    said_no, was_no = F.col("pred") < F.col("threshold"), F.col("actual") < F.col("threshold")
    counts = at.groupBy("method", "threshold").agg(
        F.count_if(said & was).alias("tp"), F.count_if(said & was_no).alias("fp"),
        F.count_if(said_no & was).alias("fn"), F.count_if(said_no & was_no).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    precision, recall, specificity = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    rates = {
        "accuracy_pct": _ratio(tp + tn, n),
        "precision_pct": precision,
        "recall_pct": recall,
        "specificity_pct": specificity,
        "f1_pct": _ratio(2 * precision * recall, precision + recall),
        "balanced_accuracy_pct": (recall + specificity) / 2,
        "prevalence_pct": _ratio(tp + fn, n),
    }
    return counts.select(
        "method", "threshold", "tp", "fp", "fn", "tn",
        *[F.round(v * 100, digits).alias(k) for k, v in rates.items()],
    )


LEVELS = ("RED", "YELLOW", "GREEN")


def level(value: Column, low: float, high: float) -> Column:
    """GREEN from ``high``, YELLOW from ``low``, else RED (also when the value is missing)."""
    return F.when(value >= high, "GREEN").when(value >= low, "YELLOW").otherwise("RED")


def _cells(stacked: DataFrame, low: float, high: float) -> DataFrame:
    """All nine confusion counts as columns of one row per method."""
    real, said = level(F.col("actual"), low, high), level(F.col("pred"), low, high)
    return stacked.withColumn("r__", real).withColumn("p__", said).groupBy("method").agg(
        *[F.count_if((F.col("r__") == r) & (F.col("p__") == p)).alias(f"{r}_{p}") for r in LEVELS for p in LEVELS]
    )


def confusion(stacked: DataFrame, low: float, high: float) -> DataFrame:
    """3x3 confusion table in long form, empty cells as zero."""
    cells = [
        F.struct(F.lit(r).alias("real"), F.lit(p).alias("predicted"), F.col(f"{r}_{p}").alias("n"))
        for r in LEVELS for p in LEVELS
    ]
    return _cells(stacked, low, high).select("method", F.inline(F.array(*cells)))


def agreement(stacked: DataFrame, low: float, high: float, digits: int = 6) -> DataFrame:
    """Accuracy, macro F1, Cohen's kappa and the F1 of each level, per method."""
    def cell(r: str, p: str) -> Column:
        return F.col(f"{r}_{p}").cast("double")

    real = {c: sum((cell(c, p) for p in LEVELS), F.lit(0.0)) for c in LEVELS}
    said = {c: sum((cell(r, c) for r in LEVELS), F.lit(0.0)) for c in LEVELS}
    total = sum(real.values(), F.lit(0.0))
    observed = sum((cell(c, c) for c in LEVELS), F.lit(0.0)) / total
    expected = sum((real[c] * said[c] for c in LEVELS), F.lit(0.0)) / (total * total)
    f1 = {}
    for c in LEVELS:
        p, r = _ratio(cell(c, c), said[c]), _ratio(cell(c, c), real[c])
        f1[c] = _ratio(2 * p * r, p + r)
    out = {
        "accuracy_pct": observed * 100,
        "f1_macro_pct": sum(f1.values(), F.lit(0.0)) / 3 * 100,
        "kappa": F.try_divide(observed - expected, 1 - expected),
        **{f"f1_{c.lower()}_pct": f1[c] * 100 for c in LEVELS},
        **{f"precision_{c.lower()}_pct": _ratio(cell(c, c), said[c]) * 100 for c in LEVELS},
        **{f"recall_{c.lower()}_pct": _ratio(cell(c, c), real[c]) * 100 for c in LEVELS},
    }
    return _cells(stacked, low, high).select("method", *[F.round(v, digits).alias(k) for k, v in out.items()])


def daily_energy(wide: DataFrame, hours_per_slot: float = 0.5, digits: int = 6) -> DataFrame:
    """Daily energy score of the model and of climatology."""
    day = wide.groupBy(F.to_date("slot").alias("day")).agg(
        (F.sum("actual") * hours_per_slot).alias("actual"),
        (F.sum("model") * hours_per_slot).alias("pred"),
        (F.sum("climatology") * hours_per_slot).alias("clim"),
    )
    sse = F.sum(_err() * _err())
    out = day.agg(
        F.count("*").alias("days"),
        F.avg(F.abs(_err())).alias("mae_model"),
        F.avg(F.abs(F.col("actual") - F.col("clim"))).alias("mae_climatology"),
        (F.try_divide(F.sum(F.abs(_err())), F.sum("actual")) * 100).alias("wape_pct"),
        F.corr("actual", "pred").alias("corr"),
        F.avg("actual").alias("mean_actual"),
        (1 - F.try_divide(sse, F.var_pop("actual") * F.count("actual"))).alias("r2"),
    )
    return out.select("days", *[F.round(c, digits).alias(c) for c in out.columns if c != "days"])


def peak_hour(wide: DataFrame, digits: int = 6) -> DataFrame:
    """How often the hour of the day's maximum is hit; ties go to the earliest hour."""
    hourly = wide.groupBy(F.to_date("slot").alias("day"), F.hour("slot").alias("h")).agg(
        F.round(F.sum("actual"), 6).alias("a"), F.round(F.sum("model"), 6).alias("m")
    )
    peak = hourly.groupBy("day").agg(
        (-F.max(F.when(F.col("a").isNotNull(), F.struct("a", (-F.col("h")).alias("k"))))["k"]).alias("h_real"),
        (-F.max(F.when(F.col("m").isNotNull(), F.struct("m", (-F.col("h")).alias("k"))))["k"]).alias("h_pred"),
        F.max("a").alias("top"),
    ).filter(F.col("top") > 0)
    gap = F.abs(F.col("h_real") - F.col("h_pred"))
    n = F.count("*")
    return peak.agg(
        n.alias("days"),
        *[F.round(F.try_divide(F.count_if(gap <= k) * 100, n).cast("double"), digits).alias(name)
          for k, name in ((0, "exact_pct"), (1, "within_1h_pct"), (2, "within_2h_pct"))],
    )


def monthly_errors(wide: DataFrame, digits: int = 6) -> DataFrame:
    """Errors by calendar month; the same month of different years is pooled."""
    out = wide.groupBy(F.month("slot").cast("long").alias("month")).agg(
        F.avg(F.abs(F.col("actual") - F.col("model"))).alias("mae_model"),
        F.avg(F.abs(F.col("actual") - F.col("climatology"))).alias("mae_climatology"),
        F.avg("actual").alias("mean_actual"),
    )
    return out.select("month", *[F.round(c, digits).alias(c) for c in out.columns if c != "month"])


def long_report(scores: DataFrame, key: str = "method") -> DataFrame:
    """Scorecard in long form with each value also written as 1.234,5."""
    from ..functions.parse import format_comma

    metrics = [c for c in scores.columns if c != key]
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]
    return scores.select(key, F.inline(F.array(*pairs))).withColumn("value_text", format_comma(F.col("value"), 1))


def truth_check(forecast: DataFrame, key: DataFrame, on: str, left: str, right: str) -> DataFrame:
    """Joined slots and the largest absolute difference between two versions of the truth."""
    both = forecast.select(on, left).join(key.select(on, right), on)
    return both.agg(F.count("*").alias("slots"), F.round(F.max(F.abs(F.col(left) - F.col(right))), 6).alias("max_abs_diff"))




def markdown(scores: DataFrame, digits: int = 1) -> str:
    """A scorecard as a Markdown table with comma decimals. Scorecards have one row per method."""
    def shown(v) -> str:
        if v is None:
            return "—"
        if isinstance(v, float):
            return f"{v:,.{digits}f}".translate(str.maketrans(",.", ".,"))
        return str(v)

    head = "| " + " | ".join(scores.columns) + " |"
    rule = "|" + "---|" * len(scores.columns)
    return "\n".join([head, rule, *("| " + " | ".join(shown(v) for v in r) + " |" for r in scores.toLocalIterator())])
