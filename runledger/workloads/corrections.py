from pyspark.sql import functions as F

from .. import fixtures as fx
from ..plans import corrections as op
from .registry import query

KIND = "ECONOMY"
STALE_SQL = f"""
, now_version AS (SELECT version, p_size FROM latest WHERE kind = '{KIND}'),
stale AS (SELECT r.*, v.version, v.p_size FROM runs r, now_version v
  WHERE r.end_ts IS NOT NULL AND coalesce(r.drift_version, 'not_set') <> v.version)
"""


def latest(spark, sf):
    return op.latest_correction(fx.corrections(spark, sf))


def formula(spark, sf, kind=KIND):
    """Stored expression of the latest definition of a kind: one configuration row."""
    return latest(spark, sf).filter(F.col("kind") == kind).select("function").first()[0]


@query("c1_latest_correction", "SELECT kind, calculation_time, version, function FROM latest", "latest")
def c1(spark, sf):
    return latest(spark, sf).select("kind", "calculation_time", "version", "function")


@query("c2_stale_runs", STALE_SQL + "SELECT number, version FROM stale", "runs", "latest")
def c2(spark, sf):
    return op.stale_runs(fx.runs(spark, sf), latest(spark, sf), KIND, "drift").select("number", "version")


@query("c3_evaluate_correction", f"""
SELECT number, round(p_size * (events_built / 1000.0) + 0.5, 9) AS value
FROM runs, (SELECT p_size FROM latest WHERE kind = '{KIND}') v""", "runs", "latest")
def c3(spark, sf):
    runs = op.evaluate_correction(fx.runs(spark, sf), formula(spark, sf),
                                  {"v": F.col("trigger.events_built") / 1000.0})
    return runs.select("number", F.round("value", 9).alias("value"))


@query("c4_drift_velocity", f"""
SELECT i.number, round((p_size * (SELECT avg(value) FROM readings r WHERE r.sensor = 'view'
   AND r.ts BETWEEN i.start_ts AND i.end_ts) + 0.5) * 0.1, 6) AS value
FROM intervals i, (SELECT p_size FROM latest WHERE kind = '{KIND}') v""", "readings", "intervals", "latest")
def c4(spark, sf):
    rows = op.drift_velocity(fx.intervals(spark, sf), fx.readings(spark, sf), formula(spark, sf), "view", 0.1)
    return rows.select("number", F.round("value", 6).alias("value"))


@query("c5_gains", """
SELECT number, n AS n_sensors, round(total, 3) AS total, round(last_gain, 6) AS last_gain FROM (
  SELECT number, CASE WHEN self_trigger THEN 12 WHEN detector = 'muon_veto' THEN 4 ELSE 12 END AS n,
    CASE WHEN self_trigger THEN 66.0 * 2 + 12 * epoch(start_ts) / 1e6
         WHEN detector = 'muon_veto' THEN 4e6 ELSE 12.0 END AS total,
    CASE WHEN self_trigger THEN 22.0 + epoch(start_ts) / 1e6
         WHEN detector = 'muon_veto' THEN 1e6 ELSE 1.0 END AS last_gain
  FROM runs) x""", "runs")
def c5(spark, sf):
    runs = op.gains(fx.runs(spark, sf), "2 * pmt + (t - t0) / 1000000", 12, 4)
    return runs.select(
        "number", F.size("gains").alias("n_sensors"),
        F.round(F.aggregate("gains", F.lit(0.0), lambda a, g: a + g), 3).alias("total"),
        F.round(F.element_at("gains", -1), 6).alias("last_gain"))


@query("c6_apply_correction", STALE_SQL + """
SELECT r.number, CASE WHEN s.number IS NOT NULL THEN round(s.p_size * r.events_built / 1000.0 + 0.5, 6)
  WHEN r.has_params THEN 2.0 END AS value, coalesce(s.version, r.drift_version) AS version
FROM runs r LEFT JOIN stale s ON s.number = r.number""", "runs", "latest")
def c6(spark, sf):
    text = formula(spark, sf)
    value = lambda runs: op.evaluate_correction(
        runs, text, {"v": F.col("trigger.events_built") / 1000.0})
    out = op.apply_correction(fx.runs(spark, sf), latest(spark, sf), KIND, "drift", "drift_velocity_liquid", value)
    return out.select("number", F.round(F.element_at("params", "drift_velocity_liquid"), 6).alias("value"),
                      F.element_at("correction_versions", "drift").alias("version"))


@query("c7_fit_polynomial", """
SELECT sensor, n, round(slope, 4) AS slope, round(my - slope * mx, 3) AS intercept FROM (
  SELECT event_type AS sensor, count(*) AS n, regr_slope(value, event_id / 1000.0) AS slope, avg(value) AS my,
    avg(event_id / 1000.0) AS mx FROM events GROUP BY 1) x""")
def c7(spark, sf):
    points = fx.table(spark, sf, "events").select(
        F.col("event_type").alias("sensor"), (F.col("event_id") / 1000.0).alias("x"), F.col("value").alias("y"))
    fits = op.fit_polynomial(points, 1)
    return fits.select("sensor", "n", F.round(F.col("coefficients")[0], 4).alias("slope"),
                       F.round(F.col("coefficients")[1], 3).alias("intercept"))


@query("c8_correction_history", f"""
SELECT kind, calculation_time, version FROM corrections WHERE kind = '{KIND}' ORDER BY calculation_time DESC""",
       "corrections")
def c8(spark, sf):
    return op.correction_history(fx.corrections(spark, sf), KIND).select("kind", "calculation_time", "version")

