"""Queries of simulator results: embeddings as spectra and decks' features."""

from __future__ import annotations

from pyspark.sql import functions as F

from circuitlake.operators import results as res
from circuitlake.plans.netlists import _D, _decks
from circuitlake.runtime import table


def _spectrum(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("run"), F.posexplode("embedding").alias("i", "y"))
    return v.select("run", (F.col("i") + 1.0).alias("x"), F.abs(F.col("y").cast("double")).alias("y"))


def noise(spark, d):
    n = res.noise_metrics(_spectrum(spark, d), 16.0, at=10.5)
    return n.select("run", F.round("density", 6).alias("density"), F.round("rms", 6).alias("rms"), "reason")


def features(spark, d):
    f = res.features(_decks(spark, d))
    return f.select("deck_id", F.round(F.col("total_width") * 1e6, 4).alias("width_um"), "devices")


def overlay(spark, d):
    t = table(spark, d, "eval_task").select(F.col("id").alias("k"), "pdk", "load")
    o = table(spark, d, "task_alias").select(F.col("new_id").alias("k"), F.lit("renamed").alias("pdk"), F.lit(None).cast("string").alias("load")).distinct()
    return res.overlay(t, o, ["k"])


def corner_grid(spark, d):
    decks = table(spark, d, "eval_task").select("id")
    corners = table(spark, d, "meas_result").select(F.try_element_at("metadata", F.lit("corner")).alias("corner")).filter("corner is not null").distinct()
    return res.monte_carlo_grid(res.corner_grid(decks, corners), 2, 7)


QUERIES = {"result_noise": noise, "result_features": features, "result_overlay": overlay, "result_corner_grid": corner_grid}

SQL = {
    "result_noise": """WITH v AS (SELECT vec_id AS run, unnest(range(len(embedding))) + 1.0::DOUBLE AS x, abs(unnest(embedding)::DOUBLE) AS y FROM embeddings), s AS (SELECT *, lead(x) OVER o AS x1, lead(y) OVER o AS y1 FROM v WINDOW o AS (PARTITION BY run ORDER BY x)),
  h AS (SELECT run, y + (log10(10.5) - log10(x)) / (log10(x1) - log10(x)) * (y1 - y) AS density FROM s WHERE x <= 10.5 AND 10.5 < x1)
SELECT s.run, round(any_value(density), 6) AS density, round(sqrt(sum(0.5 * (y * y + y1 * y1) * (x1 - x))), 6) AS rms, NULL::VARCHAR AS reason FROM s JOIN h ON h.run = s.run GROUP BY s.run""",
    "result_features": f"""WITH {_D}, w AS (SELECT deck_id, unnest(regexp_extract_all(text, '(?i)\\bW\\s*=\\s*(\\S+)', 1)) AS v FROM k),
  n AS (SELECT deck_id, lower(v) AS v, regexp_extract(lower(v), '^[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:e[+-]?\\d+)?') AS h FROM w),
  s AS (SELECT deck_id, sum(h::DOUBLE * CASE substr(v, length(h) + 1, 1) WHEN 'm' THEN 1e-3 WHEN 'u' THEN 1e-6 WHEN 'n' THEN 1e-9 WHEN 'p' THEN 1e-12 WHEN 'k' THEN 1e3 ELSE 1 END) AS t FROM n GROUP BY 1)
SELECT deck_id, round(coalesce(t, 0) * 1e6, 4) AS width_um, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[mMxX]\\w')))::INT AS devices FROM k LEFT JOIN s USING (deck_id)""",
    "result_overlay": "WITH o AS (SELECT DISTINCT new_id AS k, 'renamed' AS pdk FROM task_alias) SELECT coalesce(t.id, o.k) AS k, coalesce(o.pdk, t.pdk) AS pdk, t.load AS load FROM eval_task t FULL JOIN o ON o.k = t.id",
    "result_corner_grid": "SELECT id, corner, unnest([7, 8]) AS seed FROM eval_task CROSS JOIN (SELECT DISTINCT metadata['corner'] AS corner FROM meas_result WHERE metadata['corner'] IS NOT NULL)",
}
