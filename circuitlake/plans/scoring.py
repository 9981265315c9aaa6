"""Scoring queries over tasks' specs and station measurements.

Results are the mean `value` of a task's measurements per metric; metrics that are spec
names score, corners come from the measurement's metadata, Monte Carlo runs are the
single measurements.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from circuitlake.functions import scores
from circuitlake.operators import scoring
from circuitlake.runtime import table

# Spec names of tasks that name the same quantity as a measured metric.
SAME = {"settling": "settling_time", "pm": "phase_margin", "swing": "output_swing", "noise": "input_noise_density", "delay": "prop_delay"}


def _specs(spark, d):
    return scoring.explode_specs(table(spark, d, "eval_task"))


def _measured(spark, d):
    m = table(spark, d, "meas_result").filter("task_id is not null and value is not null and not isnan(value)")
    # one delivery of each measurement
    m = m.groupBy("meas_id").agg(F.min(F.struct("task_id", "metric", "value", F.try_element_at("metadata", F.lit("corner")).alias("corner"))).alias("r"))
    names = F.create_map(*[F.lit(x) for pair in SAME.items() for x in (pair[1], pair[0])])
    return m.select("meas_id", "r.*").select("meas_id", "task_id", F.coalesce(names[F.col("metric")], "metric").alias("spec"), "corner", "value")


def _nominal(spark, d):
    return _measured(spark, d).groupBy("task_id", "spec").agg(F.avg("value").alias("actual"))


def _scored(spark, d):
    return scoring.score_specs(_specs(spark, d), _nominal(spark, d))


def spec_scores(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return _scored(spark, d).select("task_id", "spec", r("actual"), "met", r("score"), r("margin_db"), r("contract_score"), r("shortfall"))


def task_totals(spark, d):
    t = scoring.weighted_totals(_scored(spark, d), ("task_id",))
    c = scoring.weighted_totals(_scored(spark, d), ("task_id",), "contract_score").select("task_id", F.round("total", 6).alias("contract_total"))
    return t.select("task_id", F.round("total", 6).alias("total"), "all_met").join(c, "task_id")


def _corner_totals(spark, d):
    results = _measured(spark, d).filter("corner is not null").groupBy("task_id", "corner", "spec").agg(F.avg("value").alias("actual"))
    at = results.select("task_id", "corner").distinct().join(_specs(spark, d), "task_id")
    scored = scoring.score_specs(at, results, ("task_id", "corner"))
    return scoring.weighted_totals(scored, ("task_id", "corner"))


def corner_modes(spark, d):
    nominal = scoring.weighted_totals(_scored(spark, d), ("task_id",))
    corners = _corner_totals(spark, d)
    out = None
    for mode in ("nominal", "worst", "weighted"):
        part = scoring.corner_total(nominal, corners, mode, ("task_id",)).select("task_id", F.lit(mode).alias("mode"), F.round("total", 6).alias("total"))
        out = part if out is None else out.union(part)
    return out


def monte_carlo(spark, d):
    low, high, target = F.col("low"), F.col("high"), F.col("target")
    runs = _measured(spark, d).join(_specs(spark, d), ["task_id", "spec"])
    runs = runs.select("task_id", scores.partial_credit(F.col("value"), low, high, target).alias("total"))
    return scoring.corner_total(runs, runs, "monte_carlo", ("task_id",)).select("task_id", F.round("total", 6).alias("p5"))


def feasibility_reward(spark, d):
    spec = _specs(spark, d)
    nominal = scoring.weighted_totals(_scored(spark, d), ("task_id",))
    params = spec.groupBy("task_id").agg(F.sum("weight").alias("value"), F.count(F.lit(1)).alias("n"))
    values = params.select("task_id", F.lit("area").alias("parameter"), "value").union(
        params.select("task_id", F.lit("devices"), F.col("n").cast("double"))
    )
    limits = spark.createDataFrame([("die", "area", 1.0, 3.5), ("count", "devices", None, 3.0), ("power", "watts", None, 1.0)], "name string, parameter string, low double, high double")
    checks = scoring.feasibility(values, limits, ("task_id",))
    totals = nominal.join(params, "task_id").select("task_id", "total", F.col("n").alias("step"), (F.col("value") < 7).alias("converged"))
    return scoring.reward(totals, checks, ("task_id",), step_penalty=0.1, max_steps=20).select("task_id", "feasible", F.round("reward", 6).alias("reward"))


def feasibility_checks(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.explode(F.map_from_arrays(F.array(F.lit("size"), F.lit("price")), F.array(F.col("p_size").cast("double"), "p_retailprice"))).alias("parameter", "value"))
    limits = spark.createDataFrame([("fit", "size", 10.0, 40.0), ("cost", "price", None, 1000.0)], "name string, parameter string, low double, high double")
    c = scoring.feasibility(p, limits, ("part",))
    return c.select("part", "name", "value", "bound", "passed", F.round("violation", 9).alias("violation"))


def claims(spark, d):
    claimed = _specs(spark, d).select("task_id", "spec", F.coalesce("low", "high", "target").alias("claimed")).filter("claimed is not null")
    measured = _nominal(spark, d).withColumnRenamed("actual", "measured")
    out = scoring.claims_against_measured(claimed, measured, ("task_id",))
    return out.select("task_id", "spec", F.round("claimed", 6).alias("claimed"), F.round("measured", 6).alias("measured"), "kind")


def coverage(spark, d):
    return scoring.coverage(_specs(spark, d), _nominal(spark, d)).select("task_id", F.round("coverage", 9).alias("coverage"))


def measurable(spark, d):
    return scoring.measurable(_specs(spark, d), _nominal(spark, d)).select("task_id", "spec", "weight")


QUERIES = {
    "score_specs": spec_scores,
    "score_task_totals": task_totals,
    "score_corner_modes": corner_modes,
    "score_monte_carlo_p5": monte_carlo,
    "score_feasibility": feasibility_checks,
    "score_reward": feasibility_reward,
    "score_claims": claims,
    "score_coverage": coverage,
    "score_measurable_specs": measurable,
}

_CTE = """
  specs AS (
    SELECT task_id, e.key AS spec, e.value.min AS low, e.value.max AS high, e.value.target AS target, coalesce(e.value.weight, 1.0) AS weight
    FROM (SELECT id AS task_id, unnest(map_entries(specs)) AS e FROM eval_task)),
  m AS (
    SELECT meas_id, task_id,
      CASE metric WHEN 'settling_time' THEN 'settling' WHEN 'phase_margin' THEN 'pm' WHEN 'output_swing' THEN 'swing'
                  WHEN 'input_noise_density' THEN 'noise' WHEN 'prop_delay' THEN 'delay' ELSE metric END AS spec, value, corner
    FROM (SELECT DISTINCT meas_id, task_id, metric, value, metadata['corner'] AS corner FROM meas_result
          WHERE task_id IS NOT NULL AND value IS NOT NULL AND NOT isnan(value))),
  nominal AS (SELECT task_id, spec, avg(value) AS actual FROM m GROUP BY ALL),
"""
_MIN = "CASE WHEN {b} <= 0 OR {a} <= 0 THEN CASE WHEN {a} < {b} THEN -1.0 ELSE 1.0 END ELSE greatest(-1, least(1, log2({a} / {b}))) END"
_MAX = "CASE WHEN {b} <= 0 OR {a} <= 0 THEN CASE WHEN {a} <= 0 THEN 1.0 ELSE -1.0 END ELSE greatest(-1, least(1, log2({b} / {a}))) END"
_TGT = "CASE WHEN target = 0 THEN CASE WHEN {a} = 0 THEN 1.0 ELSE -1.0 END WHEN {a} <= 0 THEN -1.0 ELSE greatest(-1, least(1, 1 - least(2, abs(log2({a} / target)) / 0.1))) END"


def _partial(a: str) -> str:
    lo, hi, t = _MIN.format(a=a, b="low"), _MAX.format(a=a, b="high"), _TGT.format(a=a)
    return f"""CASE WHEN {a} IS NULL THEN -1.0 WHEN low IS NOT NULL AND high IS NOT NULL THEN least({lo}, {hi})
      WHEN low IS NOT NULL THEN {lo} WHEN high IS NOT NULL THEN {hi} WHEN target IS NOT NULL THEN {t} ELSE 0.0 END"""


_MET = """CASE WHEN actual IS NULL THEN false WHEN low IS NOT NULL OR high IS NOT NULL THEN coalesce(actual >= low, true) AND coalesce(actual <= high, true)
      WHEN target IS NOT NULL THEN abs(actual - target) <= abs(target * 0.02) ELSE true END"""
_CONTRACT = """CASE WHEN actual IS NULL THEN -1.0 ELSE coalesce(least(
    CASE WHEN low IS NULL THEN NULL WHEN actual >= low THEN 1.0 ELSE greatest(-1, log2(CASE WHEN low > 0 THEN greatest(actual, 1e-12) / greatest(low, 1e-12) ELSE greatest(low, 1e-12) / greatest(actual, 1e-12) END)) END,
    CASE WHEN high IS NULL THEN NULL WHEN actual <= high THEN 1.0 ELSE greatest(-1, log2(CASE WHEN actual > 0 THEN greatest(high, 1e-12) / greatest(actual, 1e-12) ELSE greatest(actual, 1e-12) / greatest(high, 1e-12) END)) END), 0.0) END"""
_SCORED = f"scored AS (SELECT s.*, actual, {_MET} AS met, {_partial('actual')} AS score, {_CONTRACT} AS contract_score FROM specs s LEFT JOIN nominal USING (task_id, spec))"
_TOTALS = "totals AS (SELECT task_id, coalesce(sum(score * weight) / nullif(sum(weight), 0), 0) AS total, bool_and(met) AS all_met, coalesce(sum(contract_score * weight) / nullif(sum(weight), 0), 0) AS contract_total, sum(weight) AS w, count(*) AS n FROM scored GROUP BY task_id)"

SQL = {
    "score_specs": f"""WITH {_CTE} {_SCORED}
SELECT task_id, spec, round(actual, 6) AS actual, met, round(score, 6) AS score, round(contract_score, 6) AS contract_score,
  round(CASE WHEN actual > 0 AND low > 0 AND high IS NULL THEN 20 * log10(actual / low) WHEN actual > 0 AND high > 0 AND low IS NULL THEN 20 * log10(high / actual) END, 6) AS margin_db,
  round(CASE WHEN actual < low THEN CASE WHEN actual > 0 AND low > 0 THEN log10(low / actual) ELSE abs(low - actual) / CASE WHEN low = 0 THEN 1 ELSE abs(low) END END
             WHEN actual > high THEN CASE WHEN actual > 0 AND high > 0 THEN log10(actual / high) ELSE abs(actual - high) / CASE WHEN high = 0 THEN 1 ELSE abs(high) END END
             WHEN target <> 0 AND abs(actual - target) / abs(target) > 0.02 THEN abs(actual - target) / abs(target) END, 6) AS shortfall
FROM scored""",
    "score_task_totals": f"WITH {_CTE} {_SCORED}, {_TOTALS} SELECT task_id, round(total, 6) AS total, all_met, round(contract_total, 6) AS contract_total FROM totals",
    "score_corner_modes": f"""WITH {_CTE} {_SCORED}, {_TOTALS},
  cr AS (SELECT task_id, corner, spec, avg(value) AS actual FROM m WHERE corner IS NOT NULL GROUP BY ALL),
  cs AS (SELECT k.task_id, k.corner, s.weight, {_partial("r.actual")} AS score
         FROM (SELECT DISTINCT task_id, corner FROM cr) k JOIN specs s USING (task_id) LEFT JOIN cr r ON r.task_id = k.task_id AND r.corner = k.corner AND r.spec = s.spec),
  ct AS (SELECT task_id, corner, coalesce(sum(score * weight) / nullif(sum(weight), 0), 0) AS total FROM cs GROUP BY ALL),
  ca AS (SELECT task_id, min(total) AS worst, sum(total) AS s, count(*) AS n FROM ct GROUP BY 1)
SELECT task_id, 'nominal' AS mode, round(total, 6) AS total FROM totals
UNION ALL SELECT task_id, 'worst', round(least(total, worst), 6) FROM totals LEFT JOIN ca USING (task_id)
UNION ALL SELECT task_id, 'weighted', round((total + coalesce(s, 0)) / (1 + coalesce(ca.n, 0)), 6) FROM totals LEFT JOIN ca USING (task_id)""",
    "score_monte_carlo_p5": f"""WITH {_CTE}
  runs AS (SELECT task_id, {_partial("value")} AS total FROM m JOIN specs USING (task_id, spec)),
  lists AS (SELECT task_id, list(total ORDER BY total) AS l FROM runs GROUP BY task_id)
SELECT task_id, round(l[CAST(floor(len(l) * 0.05) AS INT) + 1], 6) AS p5 FROM lists""",
    "score_feasibility": """
SELECT p_partkey AS part, 'fit' AS name, CAST(p_size AS DOUBLE) AS value, 10.0::DOUBLE AS bound, p_size BETWEEN 10 AND 40 AS passed,
  round(CASE WHEN p_size < 10 THEN (10 - p_size) / 10.0::DOUBLE WHEN p_size > 40 THEN (p_size - 40) / 40.0::DOUBLE ELSE 0 END, 9) AS violation FROM part
UNION ALL SELECT p_partkey, 'cost', p_retailprice, 1000.0, p_retailprice <= 1000, round(CASE WHEN p_retailprice > 1000 THEN (p_retailprice - 1000) / 1000 ELSE 0 END, 9) FROM part""",
    "score_reward": f"""WITH {_CTE} {_SCORED}, {_TOTALS},
  f AS (SELECT *, w BETWEEN 1 AND 3.5 AND n <= 3 AS feasible,
    greatest(CASE WHEN w < 1 THEN 1 - w WHEN w > 3.5 THEN (w - 3.5) / 3.5 ELSE 0 END, CASE WHEN n > 3 THEN (n - 3) / 3.0::DOUBLE ELSE 0 END) AS worst FROM totals)
SELECT task_id, feasible, round(CASE WHEN NOT w < 7 THEN -0.5 ELSE total * CASE WHEN feasible THEN 1 ELSE 0.1::DOUBLE / (1 + worst) END - 0.1::DOUBLE * n / 20 END, 6) AS reward FROM f""",
    "score_claims": f"""WITH {_CTE} c AS (SELECT task_id, spec, coalesce(low, high, target) AS claimed, actual AS measured FROM specs LEFT JOIN nominal USING (task_id, spec))
SELECT task_id, spec, round(claimed, 6) AS claimed, round(measured, 6) AS measured, CASE WHEN measured IS NULL THEN 'not_measured' ELSE 'differs' END AS kind FROM c
WHERE claimed IS NOT NULL AND (measured IS NULL OR abs(claimed - measured) / greatest(abs(measured), abs(claimed), 1e-30) > 0.05)""",
    "score_coverage": f"WITH {_CTE} x AS (SELECT 1) SELECT task_id, round(count(actual) / count(*)::DOUBLE, 9) AS coverage FROM specs LEFT JOIN nominal USING (task_id, spec) GROUP BY task_id",
    "score_measurable_specs": f"WITH {_CTE} x AS (SELECT 1) SELECT task_id, spec, weight FROM specs SEMI JOIN nominal USING (task_id, spec)",
}
