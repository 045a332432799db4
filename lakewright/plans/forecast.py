"""Baselines over half-hour totals of ``events`` and their scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast_eval as fe
from ..operators import timeseries as ts
from ..operators.ordered import positions, shift_values
from ..sources.tables import table
from .registry import query

THRESHOLDS = (200.0, 300.0, 450.0, 600.0)
LOW, HIGH = 200.0, 450.0


def wide(spark, folder):
    totals = ts.slot_totals(table(spark, folder, "events"), "ts", "value")
    return ts.baselines(ts.fill_grid(totals))


def stacked(spark, folder):
    return ts.stack_methods(wide(spark, folder))


WIDE_SQL = """
WITH tot AS (
  SELECT time_bucket(INTERVAL '30 minutes', ts) AS slot, round(sum(value), 2) AS v FROM events GROUP BY 1),
spine AS (
  SELECT unnest(generate_series((SELECT min(slot) FROM tot), (SELECT max(slot) FROM tot), INTERVAL '30 minutes')) AS slot),
g AS (SELECT s.slot, coalesce(t.v, 0.0) AS actual FROM spine s LEFT JOIN tot t USING (slot)),
clim AS (
  SELECT month(slot) AS mo, weekofyear(slot) AS wk, hour(slot) * 60 + minute(slot) AS sd, round(avg(actual), 6) AS climatology
  FROM g GROUP BY ALL),
trail AS (
  SELECT slot, round(avg(actual) OVER (PARTITION BY hour(slot) * 60 + minute(slot) ORDER BY slot
                                       ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS model FROM g),
wide AS (
  SELECT g.slot, g.actual, a.actual AS d1, b.actual AS d2, c.actual AS d7,
         CASE WHEN hour(g.slot) < 12 THEN a.actual ELSE b.actual END AS d1_real, trail.model, clim.climatology
  FROM g LEFT JOIN g a ON a.slot = g.slot - INTERVAL 1 DAY
         LEFT JOIN g b ON b.slot = g.slot - INTERVAL 2 DAY
         LEFT JOIN g c ON c.slot = g.slot - INTERVAL 7 DAY
         JOIN trail ON trail.slot = g.slot
         JOIN clim ON clim.mo = month(g.slot) AND clim.wk = weekofyear(g.slot) AND clim.sd = hour(g.slot) * 60 + minute(g.slot)),
st AS (
  SELECT slot, actual, 'model' AS method, model AS pred FROM wide WHERE d7 IS NOT NULL
  UNION ALL SELECT slot, actual, 'climatology', climatology FROM wide WHERE d7 IS NOT NULL
  UNION ALL SELECT slot, actual, 'persistence_d1', d1 FROM wide WHERE d7 IS NOT NULL
  UNION ALL SELECT slot, actual, 'persistence_real', d1_real FROM wide WHERE d7 IS NOT NULL
  UNION ALL SELECT slot, actual, 'weekly_d7', d7 FROM wide WHERE d7 IS NOT NULL)
"""


@query("fc_baselines", WIDE_SQL + """
SELECT strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, actual, d1, d2, d7, d1_real, model, climatology FROM wide
""")
def fc_baselines(spark, folder):
    return wide(spark, folder).withColumn("slot", F.date_format("slot", "yyyy-MM-dd HH:mm:ss"))


REGRESSION_SQL = WIDE_SQL + """,
scores AS (
  SELECT method, round(avg(abs(actual - pred)), 6) AS mae, round(sqrt(avg(pow(actual - pred, 2))), 6) AS rmse,
         round(avg(pred - actual), 6) + 0.0::DOUBLE AS bias, round(sum(abs(actual - pred)) / nullif(sum(actual), 0) * 100, 6) AS wape_pct,
         round(1 - sum(pow(actual - pred, 2)) / nullif(sum(pow(actual - (SELECT avg(actual) FROM wide WHERE d7 IS NOT NULL), 2)), 0), 6) AS r2,
         round(corr(actual, pred), 6) AS corr,
         round(avg(abs(actual - pred)) FILTER (WHERE actual > 0), 6) AS mae_pos
  FROM st GROUP BY method)
"""


@query("fc_regression", REGRESSION_SQL + "SELECT * FROM scores")
def fc_regression(spark, folder):
    return fe.regression(stacked(spark, folder))


@query("fc_skill_gain", WIDE_SQL + """,
m AS (SELECT method, round(avg(abs(actual - pred)), 1) AS mae FROM st GROUP BY 1)
SELECT method, round((1 - (SELECT mae FROM m WHERE method = 'model') / nullif(mae, 0)) * 100, 1) AS gain_pct
FROM m WHERE method <> 'model'
""")
def fc_skill_gain(spark, folder):
    return fe.skill_gain(stacked(spark, folder))


@query("fc_binary", WIDE_SQL + """,
c AS (
  SELECT method, threshold,
         count(*) FILTER (WHERE pred >= threshold AND actual >= threshold) AS tp,
         count(*) FILTER (WHERE pred >= threshold AND actual < threshold) AS fp,
         count(*) FILTER (WHERE pred < threshold AND actual >= threshold) AS fn,
         count(*) FILTER (WHERE pred < threshold AND actual < threshold) AS tn
  FROM st, (SELECT unnest([200.0, 300.0, 450.0, 600.0])::DOUBLE AS threshold) GROUP BY 1, 2),
r AS (
  SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS rc,
         coalesce(tn / nullif(tn + fp, 0), 0) AS sp FROM c)
SELECT method, threshold, tp, fp, fn, tn,
       round((tp + tn) / (tp + fp + fn + tn) * 100, 6) AS accuracy_pct, round(p * 100, 6) AS precision_pct,
       round(rc * 100, 6) AS recall_pct, round(sp * 100, 6) AS specificity_pct,
       round(coalesce(2 * p * rc / nullif(p + rc, 0), 0) * 100, 6) AS f1_pct,
       round((rc + sp) / 2 * 100, 6) AS balanced_accuracy_pct,
       round((tp + fn) / (tp + fp + fn + tn) * 100, 6) AS prevalence_pct
FROM r
""")
def fc_binary(spark, folder):
    return fe.binary_events(stacked(spark, folder), THRESHOLDS)


LEVEL_SQL = """,
lv AS (
  SELECT method, CASE WHEN actual >= 450 THEN 'GREEN' WHEN actual >= 200 THEN 'YELLOW' ELSE 'RED' END AS rl,
         CASE WHEN pred >= 450 THEN 'GREEN' WHEN pred >= 200 THEN 'YELLOW' ELSE 'RED' END AS pl FROM st),
names AS (SELECT unnest(['RED', 'YELLOW', 'GREEN']) AS name),
conf AS (
  SELECT m.method, a.name AS "real", b.name AS predicted,
         (SELECT count(*) FROM lv WHERE lv.method = m.method AND rl = a.name AND pl = b.name) AS n
  FROM (SELECT DISTINCT method FROM st) m, names a, names b)
"""


@query("fc_confusion3", WIDE_SQL + LEVEL_SQL + 'SELECT method, "real", predicted, n FROM conf')
def fc_confusion3(spark, folder):
    return fe.confusion(stacked(spark, folder), LOW, HIGH)


@query("fc_kappa", WIDE_SQL + LEVEL_SQL + """,
marg AS (
  SELECT method, name, sum(n) FILTER (WHERE "real" = name AND predicted = name)::DOUBLE AS hit,
         sum(n) FILTER (WHERE "real" = name)::DOUBLE AS rn, sum(n) FILTER (WHERE predicted = name)::DOUBLE AS pn
  FROM conf, names GROUP BY 1, 2),
cls AS (SELECT *, coalesce(hit / nullif(pn, 0), 0) AS p, coalesce(hit / nullif(rn, 0), 0) AS r FROM marg),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM cls),
o AS (
  SELECT method, sum(hit) / sum(rn) AS po, sum(rn * pn) / pow(sum(rn), 2) AS pe, avg(f1) AS macro,
         max(f1) FILTER (WHERE name = 'RED') AS fr, max(f1) FILTER (WHERE name = 'YELLOW') AS fy, max(f1) FILTER (WHERE name = 'GREEN') AS fg,
         max(p) FILTER (WHERE name = 'RED') AS pr, max(p) FILTER (WHERE name = 'YELLOW') AS py, max(p) FILTER (WHERE name = 'GREEN') AS pg,
         max(r) FILTER (WHERE name = 'RED') AS rr, max(r) FILTER (WHERE name = 'YELLOW') AS ry, max(r) FILTER (WHERE name = 'GREEN') AS rg
  FROM f GROUP BY method)
SELECT method, round(po * 100, 6) AS accuracy_pct, round(macro * 100, 6) AS f1_macro_pct,
       round((po - pe) / nullif(1 - pe, 0), 6) AS kappa,
       round(fr * 100, 6) AS f1_red_pct, round(fy * 100, 6) AS f1_yellow_pct, round(fg * 100, 6) AS f1_green_pct,
       round(pr * 100, 6) AS precision_red_pct, round(py * 100, 6) AS precision_yellow_pct, round(pg * 100, 6) AS precision_green_pct,
       round(rr * 100, 6) AS recall_red_pct, round(ry * 100, 6) AS recall_yellow_pct, round(rg * 100, 6) AS recall_green_pct
FROM o
""")
def fc_kappa(spark, folder):
    return fe.agreement(stacked(spark, folder), LOW, HIGH)


@query("fc_daily_energy", WIDE_SQL + """,
d AS (
  SELECT CAST(slot AS DATE) AS day, sum(actual) * 0.5 AS a, sum(model) * 0.5 AS m, sum(climatology) * 0.5 AS c FROM wide GROUP BY 1)
SELECT count(*) AS days, round(avg(abs(a - m)), 6) AS mae_model, round(avg(abs(a - c)), 6) AS mae_climatology,
       round(sum(abs(a - m)) / sum(a) * 100, 6) AS wape_pct, round(corr(a, m), 6) AS corr, round(avg(a), 6) AS mean_actual,
       round(1 - sum(pow(a - m, 2)) / sum(pow(a - (SELECT avg(a) FROM d), 2)), 6) AS r2
FROM d
""")
def fc_daily_energy(spark, folder):
    return fe.daily_energy(wide(spark, folder))


@query("fc_peak_hour", WIDE_SQL + """,
h AS (
  SELECT CAST(slot AS DATE) AS day, hour(slot) AS h, round(sum(actual), 6) AS a, round(sum(model), 6) AS m FROM wide GROUP BY 1, 2),
ra AS (SELECT day, h AS h_real, a AS top, row_number() OVER (PARTITION BY day ORDER BY a DESC, h) AS k FROM h),
rm AS (SELECT day, h AS h_pred, row_number() OVER (PARTITION BY day ORDER BY m DESC, h) AS k FROM h WHERE m IS NOT NULL),
p AS (SELECT ra.day, h_real, h_pred FROM ra LEFT JOIN rm ON rm.day = ra.day AND rm.k = 1 WHERE ra.k = 1 AND top > 0)
SELECT count(*) AS days, round(count(*) FILTER (WHERE h_real = h_pred) * 100 / count(*), 6) AS exact_pct,
       round(count(*) FILTER (WHERE abs(h_real - h_pred) <= 1) * 100 / count(*), 6) AS within_1h_pct,
       round(count(*) FILTER (WHERE abs(h_real - h_pred) <= 2) * 100 / count(*), 6) AS within_2h_pct
FROM p
""")
def fc_peak_hour(spark, folder):
    return fe.peak_hour(wide(spark, folder))


@query("fc_monthly", WIDE_SQL + """
SELECT month(slot) AS month, round(avg(abs(actual - model)), 6) AS mae_model,
       round(avg(abs(actual - climatology)), 6) AS mae_climatology, round(avg(actual), 6) AS mean_actual
FROM wide GROUP BY 1
""")
def fc_monthly(spark, folder):
    return fe.monthly_errors(wide(spark, folder))


@query("fc_climatology", WIDE_SQL + """
SELECT mo AS month, wk AS week, sd AS slot_of_day, climatology FROM clim
""")
def fc_climatology(spark, folder):
    totals = ts.slot_totals(table(spark, folder, "events"), "ts", "value")
    return ts.climatology(ts.fill_grid(totals))


@query("fc_truth_check", """
WITH f AS (SELECT time_bucket(INTERVAL '30 minutes', ts) AS slot, round(sum(value), 2) AS actual FROM events GROUP BY 1),
k AS (
  SELECT slot, sum(v) AS truth FROM (
    SELECT time_bucket(INTERVAL '30 minutes', ts) AS slot, event_type, sum(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1)
SELECT count(*) AS slots, round(max(abs(actual - truth)), 6) AS max_abs_diff FROM f JOIN k USING (slot)
""")
def fc_truth_check(spark, folder):
    events = table(spark, folder, "events")
    forecast = ts.slot_totals(events, "ts", "value")
    parts = ts.slot_totals(events, "ts", "value", keys=["event_type"])
    key = parts.groupBy("slot").agg(F.sum("actual").alias("truth"))
    return fe.truth_check(forecast, key, "slot", "actual", "truth")


@query("fc_report_long", REGRESSION_SQL + """,
l AS (UNPIVOT scores ON mae, rmse, bias, wape_pct, r2, corr, mae_pos INTO NAME metric VALUE value)
SELECT method, metric, value, translate(format('{:,.1f}', value), ',.', '.,') AS value_text FROM l
""")
def fc_report_long(spark, folder):
    return fe.long_report(fe.regression(stacked(spark, folder)))


@query("fc_lag_by_user", """
SELECT event_id, user_id, value, lag(value, 1) OVER w AS lag1, lag(value, 3) OVER w AS lag3
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def fc_lag_by_user(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    placed = positions(events, ["user_id"], [F.col("ts"), F.col("event_id")], F.date_trunc("minute", "ts"))
    lags = {f"lag{n}": (n, F.col("pos") + n) for n in (1, 3)}
    return shift_values(placed, ["user_id"], "pos", "value", lags, carry=["event_id"]).drop("pos")
