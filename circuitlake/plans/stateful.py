"""Event-time window queries on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from circuitlake.runtime import table
from circuitlake.sources import sinks
from circuitlake.streaming import events as ev


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df):
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if t == "timestamp" else F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def safe(spark, d):
    m = table(spark, d, "meas_result").select("meas_id", F.array(F.col("value") * 1.0471975511965976, F.lit(float("inf"))).alias("values")).distinct()
    s = sinks.json_safe(m)
    return s.select("meas_id", F.try_element_at("values", F.lit(1)).alias("value"), F.size(F.array_compact("values")).alias("kept"))


QUERIES = {
    "window_tumbling": lambda spark, d: _plain(ev.tumbling(_events(spark, d))),
    "window_sliding": lambda spark, d: _plain(ev.sliding(_events(spark, d))),
    "window_sessions": lambda spark, d: _plain(ev.sessions(_events(spark, d))),
    "sink_json_safe": safe,
    "sink_non_finite": lambda spark, d: sinks.count_non_finite(table(spark, d, "meas_result"), "value"),
}

_F = "strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"
SQL = {
    "window_tumbling": f"""SELECT {_F.format(x="time_bucket(INTERVAL 1 hour, ts)")} AS start, {_F.format(x="time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour")} AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
    "window_sliding": f"""WITH w AS (SELECT *, time_bucket(INTERVAL 15 minutes, ts) - to_minutes(15 * k) AS s FROM events, range(4) r(k))
SELECT {_F.format(x="s")} AS start, {_F.format(x="s + INTERVAL 1 hour")} AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""",
    "window_sessions": f"""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 minutes THEN 0 ELSE 1 END AS f FROM events), b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a)
SELECT user_id, {_F.format(x="min(ts)")} AS start, {_F.format(x="max(ts) + INTERVAL 30 minutes")} AS "end", count(*) AS events, round(sum(value), 4) AS total FROM b GROUP BY user_id, g""",
    "sink_json_safe": "SELECT DISTINCT meas_id, CASE WHEN isnan(value) OR isinf(value) THEN NULL WHEN value = 0 THEN 0 ELSE printf('%.5e', value * 1.0471975511965976::DOUBLE)::DOUBLE END AS value, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 0 ELSE 1 END::INT AS kept FROM meas_result",
    "sink_non_finite": "SELECT count(*) FILTER (isnan(value) OR isinf(value)) AS non_finite FROM meas_result",
}
