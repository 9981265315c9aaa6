"""Evaluation queries: demo records as evaluation results of runs (their sources), benchmark rows as scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from circuitlake.operators import evaluation as ev
from circuitlake.runtime import table


def _rounded(df, digits=6):
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _results(spark, d):
    t = table(spark, d, "demo_output").select("id", "source", "task_id", "success", "score", F.coalesce(F.size("messages"), F.lit(0)).alias("n")).distinct()
    steps = F.greatest("n", F.lit(0))
    return t.select(
        "id", F.col("source").alias("run"), F.lower(F.trim("task_id")).alias("task"), F.coalesce("success", F.lit(False)).alias("passed"), F.coalesce("score", F.lit(0.0)).alias("score"),
        steps.alias("steps"), (steps * 1.5).alias("seconds"), F.when(F.col("score").isNull(), "no score").alias("error"),
    )


def _bench(spark, d):
    return table(spark, d, "benchmark").select("id", "category", "difficulty", "model", (F.col("overall") >= 0.5).alias("passed"), F.col("overall").alias("score")).distinct()


def _per_task(spark, d, run):
    rows = _results(spark, d).filter(F.col("run") == run).filter("task is not null")
    return rows.groupBy("task").agg(F.bool_or("passed").alias("passed"), F.avg("score").alias("score"))


def _turns(spark, d):
    rows = table(spark, d, "rl_ngspice_demo")
    rows = rows.groupBy("run_id", "step").agg(F.min_by(F.struct("action", "observation", "reward"), "received_at").alias("r")).select("run_id", "step", "r.*")
    reward = F.when(~F.isnan("reward"), F.col("reward"))
    return rows.select(
        F.col("run_id").alias("run"), F.col("step").alias("turn"), F.col("action.name").alias("tool"), F.startswith("observation", F.lit("{")).cast("int").alias("values"),
        reward.alias("score"), F.when(F.col("observation") == "no convergence", 1.5).alias("shortfall"), "observation",
    )


def rewards(spark, d):
    t = _turns(spark, d).filter("tool is not null")
    ok = ~F.coalesce(F.col("observation") == "no convergence", F.lit(False))
    score = F.try_to_number(F.get_json_object("observation", "$.score"), F.lit("S9.999999")).cast("double")
    steps = t.select("run", F.col("turn").alias("step"), "tool", ok.alias("ok"), F.coalesce(score, F.lit(0.0)).alias("score"), (F.get_json_object("observation", "$.passed") == "true").alias("passed"))
    return _rounded(ev.step_rewards(steps), 9)


def ranks(spark, d):
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("i"), F.col("l_extendedprice").alias("reward"))
    r = ev.group_ranks(o)
    return r.select("grp", F.col("i.l_linenumber").alias("line"), "reward", "rank", F.round("advantage", 6).alias("advantage"), "best", "worst", F.round("spread", 4).alias("spread"))


def losses(spark, d):
    e = table(spark, d, "events")
    logs = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return _rounded(ev.loss_summary(logs.union(logs.filter("step % 3 = 0")), "run"))


def responses(spark, d):
    b = table(spark, d, "benchmark").select("id", F.coalesce("response_preview", F.lit("")).alias("r")).distinct()
    one = ev.response_score(F.col("r"), ["gain", "bandwidth", "offset"], ["sim.dc", "netlist.patch"])
    flags = ev.flag_score(F.col("r"), [["gain", "kazanç"], ["because", "since"], ["sim.", "netlist."], ["```"], ["sweep"], ["limit"]])
    return b.select("id", F.round(one, 6).alias("overall"), flags.alias("flags"))


def best(spark, d):
    t = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("i"), F.when(F.col("event_type") != "error", F.col("value")).alias("score"))
    return ev.running_best(t, 40)


QUERIES = {
    "eval_metrics": lambda spark, d: _rounded(ev.metrics(_results(spark, d), "run")),
    "eval_grouped_rates": lambda spark, d: _rounded(ev.grouped_rates(_bench(spark, d))),
    "eval_category_means": lambda spark, d: _rounded(ev.category_means(_bench(spark, d), "category", "score")),
    "eval_compare_runs": lambda spark, d: _rounded(
        ev.compare(*[ev.metrics(_results(spark, d).filter(F.col("run") == r), "run") for r in ("grounded", "replay")])
    ),
    "eval_task_difference": lambda spark, d: ev.task_difference(_per_task(spark, d, "grounded"), _per_task(spark, d, "replay")),
    "eval_task_changes": lambda spark, d: _rounded(ev.task_changes(_per_task(spark, d, "grounded"), _per_task(spark, d, "replay"))),
    "eval_movers": lambda spark, d: _rounded(ev.movers(ev.task_changes(_per_task(spark, d, "grounded"), _per_task(spark, d, "replay")))),
    "eval_behaviour": lambda spark, d: ev.behaviour(_turns(spark, d)),
    "eval_stuck_turns": lambda spark, d: ev.stuck_turns(_turns(spark, d).filter("tool is not null")),
    "eval_retry_strategy": lambda spark, d: ev.retry_strategy(_turns(spark, d).filter("tool is not null")),
    "eval_group_ranks": ranks,
    "eval_throughput": lambda spark, d: _rounded(
        ev.throughput(table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("amount"), (F.col("l_extendedprice") / 1000).alias("seconds")), "l_returnflag")
    ),
    "eval_loss_summary": losses,
    "eval_step_rewards": rewards,
    "eval_running_best": best,
    "eval_response_scores": responses,
    "eval_dry_run_counts": lambda spark, d: table(spark, d, "eval_task").groupBy("category", "difficulty").count(),
    "eval_training_hours": lambda spark, d: table(spark, d, "part").select(
        "p_partkey", F.round(ev.training_hours(F.col("p_size"), F.lit(4), F.lit(8)), 6).alias("hours")
    ),
}

_R = """r AS (SELECT DISTINCT id, source AS run, lower(trim(task_id)) AS task, coalesce(success, false) AS passed, coalesce(score, 0) AS score, coalesce(len(messages), 0) AS steps,
    coalesce(len(messages), 0) * 1.5::DOUBLE AS seconds, CASE WHEN score IS NULL THEN 'no score' END AS error FROM demo_output)"""
_B = "b AS (SELECT DISTINCT id, category, difficulty, model, overall >= 0.5 AS passed, overall AS score FROM benchmark)"
_AGG = """coalesce(sum(score) FILTER (steps > 0) / nullif(sum(steps) FILTER (steps > 0), 0), 0)"""
_T = "a AS (SELECT task, bool_or(passed) AS passed, avg(score) AS score FROM r WHERE run = 'grounded' AND task IS NOT NULL GROUP BY task), c AS (SELECT task, bool_or(passed) AS passed, avg(score) AS score FROM r WHERE run = 'replay' AND task IS NOT NULL GROUP BY task)"
_CH = "ch AS (SELECT task, a.score AS sa, c.score AS sb, c.score - a.score AS delta, CASE WHEN NOT a.passed AND c.passed THEN 'up' WHEN a.passed AND NOT c.passed THEN 'down' END AS flip, CASE WHEN a.score IS NULL THEN 'first' WHEN c.score IS NULL THEN 'second' END AS missing FROM a FULL JOIN c USING (task))"
_TURNS = """t AS (SELECT run_id AS run, step AS turn, action.name AS tool, CAST(starts_with(observation, '{') AS INT) AS "values", CASE WHEN NOT isnan(reward) THEN reward END AS score,
    CASE WHEN observation = 'no convergence' THEN 1.5 END AS shortfall, observation FROM rl_ngspice_demo QUALIFY row_number() OVER (PARTITION BY run_id, step ORDER BY received_at) = 1)"""
_REP = "tool IS NOT NULL AND coalesce(lag(tool) OVER o = tool, false) AND coalesce(lag(tool, 2) OVER o = tool, false)"

SQL = {
    "eval_metrics": f"""WITH {_R} SELECT run, count(*) AS n, count(*) FILTER (passed) AS passed, round(avg(passed::INT), 6) AS pass_rate, round(avg(score), 6) AS mean_score, round(coalesce(avg(steps) FILTER (passed), 0), 6) AS mean_steps_passed,
  round(avg(steps), 6) AS mean_steps, round({_AGG}, 6) AS efficiency, round(median(score), 6) AS median_score, round(coalesce(stddev_samp(score), 0), 6) AS sd_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score,
  round(sum(seconds), 6) AS seconds, count(error) AS errors FROM r GROUP BY run""",
    "eval_grouped_rates": f"WITH {_B} SELECT category, difficulty, grouping(category, difficulty) AS level, count(*) AS n, round(avg(coalesce(passed, false)::INT), 6) AS pass_rate, round(avg(score), 6) AS mean_score FROM b GROUP BY GROUPING SETS ((), (category), (difficulty))",
    "eval_category_means": f"WITH {_B} SELECT category, grouping(category) AS is_total, count(score) AS n, round(avg(score), 6) AS mean FROM b GROUP BY ROLLUP(category)",
    "eval_compare_runs": f"""WITH {_R}, m AS (SELECT run, avg(passed::INT) AS p, avg(score) AS s, {_AGG} AS e FROM r GROUP BY run)
SELECT round(y.p - x.p, 6) AS delta_pass_rate, round(y.s - x.s, 6) AS delta_mean_score, round(y.e - x.e, 6) AS delta_efficiency FROM m x, m y WHERE x.run = 'grounded' AND y.run = 'replay'""",
    "eval_task_difference": f"WITH {_R}, {_T} SELECT task, 'first' AS side FROM a ANTI JOIN c USING (task) UNION ALL SELECT task, 'second' FROM c ANTI JOIN a USING (task)",
    "eval_task_changes": f"WITH {_R}, {_T}, {_CH} SELECT task, round(sa, 6) AS sa, round(sb, 6) AS sb, round(delta, 6) AS delta, flip, missing FROM ch",
    "eval_movers": f"WITH {_R}, {_T}, {_CH} SELECT task, round(sa, 6) AS sa, round(sb, 6) AS sb, round(delta, 6) AS delta, flip, missing FROM ch WHERE abs(delta) > 1e-9 ORDER BY abs(ch.delta) DESC, task LIMIT 8",
    "eval_behaviour": f'WITH {_TURNS} SELECT run, count(tool) AS calls, count(DISTINCT tool) AS tools, coalesce(sum("values"), 0)::BIGINT AS measured, count(tool) >= 3 AND count(DISTINCT tool) = 1 AS stuck FROM t GROUP BY run',
    "eval_stuck_turns": f"WITH {_TURNS}, u AS (SELECT * FROM t WHERE tool IS NOT NULL) SELECT run, turn, tool FROM u QUALIFY {_REP} WINDOW o AS (PARTITION BY run ORDER BY turn)".replace("QUALIFY " + _REP + " WINDOW o AS (PARTITION BY run ORDER BY turn)", "WINDOW o AS (PARTITION BY run ORDER BY turn) QUALIFY " + _REP),
    "eval_retry_strategy": f"""WITH {_TURNS}, u AS (SELECT * FROM t WHERE tool IS NOT NULL)
SELECT run, turn, CASE WHEN ({_REP}) OR coalesce(shortfall > 1, false) THEN 'change_topology' WHEN score > lag(score) OVER o THEN 'same_approach'
  WHEN count(score) OVER (PARTITION BY run ORDER BY turn ROWS UNBOUNDED PRECEDING) >= 4 AND score <= min(score) OVER (PARTITION BY run ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) THEN 'escalate' ELSE 'modify_params' END AS strategy
FROM u WINDOW o AS (PARTITION BY run ORDER BY turn)""",
    "eval_group_ranks": """SELECT l_orderkey AS grp, l_linenumber AS line, l_extendedprice AS reward, (row_number() OVER o - 1)::INT AS rank, round(1 - 2 * (row_number() OVER o - 1) / 3.0::DOUBLE, 6) AS advantage,
  max(l_extendedprice) OVER g AS best, min(l_extendedprice) OVER g AS worst, round(max(l_extendedprice) OVER g - min(l_extendedprice) OVER g, 4) AS spread
FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_shipdate), g AS (PARTITION BY l_orderkey)""",
    "eval_throughput": "SELECT l_returnflag, round(avg(l_quantity / (l_extendedprice / 1000)), 6) AS mean_of_rates, round(sum(l_quantity) / sum(l_extendedprice / 1000), 6) AS ratio_of_sums FROM lineitem GROUP BY 1",
    "eval_loss_summary": """SELECT user_id AS run, round(arg_min(value, event_id), 6) AS first, round(arg_max(value, event_id), 6) AS last, round(min(value), 6) AS least, max(event_id) AS last_step,
  round((arg_min(value, event_id) - arg_max(value, event_id)) * 100 / nullif(arg_min(value, event_id), 0), 6) AS reduction_pct FROM events GROUP BY 1""",
    "eval_step_rewards": f"""WITH {_TURNS}, u AS (SELECT run, turn AS step, tool, NOT coalesce(observation = 'no convergence', false) AS ok, CASE WHEN json_valid(observation) THEN coalesce(TRY_CAST(json_extract_string(observation, '$.score') AS DOUBLE), 0) ELSE 0 END AS sc,
    CASE WHEN json_valid(observation) THEN coalesce(json_extract_string(observation, '$.passed') = 'true', false) ELSE false END AS passed FROM t WHERE tool IS NOT NULL),
  v AS (SELECT *, -0.005::DOUBLE + CASE WHEN tool LIKE 'sim.%' AND ok THEN 0.02 ELSE 0 END + CASE WHEN tool = 'sim.corners' AND ok THEN 0.05 ELSE 0 END + CASE WHEN tool = 'spec.check' AND ok THEN 0.5 * sc + CASE WHEN passed THEN 1 ELSE 0 END ELSE 0 END AS counted FROM u)
SELECT run, step, tool, round(counted - CASE WHEN tool LIKE 'sim.%' AND NOT ok THEN 0.1 ELSE 0 END, 9) AS reward, round(sum(counted) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING), 9) + 0 AS total FROM v""",
    "eval_running_best": """WITH r AS (SELECT user_id AS run, event_id AS i, CASE WHEN event_type <> 'error' THEN value ELSE -1e6 END AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT run, i, max(v) OVER (PARTITION BY run ORDER BY i ROWS UNBOUNDED PRECEDING) AS best FROM r WHERE k <= 40""",
    "eval_response_scores": r"""WITH b AS (SELECT DISTINCT id, coalesce(response_preview, '') AS r FROM benchmark), s AS (SELECT *, lower(r) AS l, regexp_replace(r, '^\s+|\s+$', '', 'g') AS t FROM b)
SELECT id, round(0.4 * (contains(l, 'gain')::INT + contains(l, 'bandwidth')::INT + contains(l, 'offset')::INT) / 3.0::DOUBLE + 0.2 * (contains(r, 'sim.dc')::INT + contains(r, 'netlist.patch')::INT) / 2.0::DOUBLE
  + 0.2 * least(1, CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(t, '\s+')) END / 100.0::DOUBLE)
  + 0.2 * (0.5 * (contains(r, '```') OR contains(r, '.model') OR contains(r, 'module'))::INT + 0.5 * regexp_matches(l, 'because|since|therefore|strategy|approach')::INT), 6) AS overall,
  (contains(l, 'gain') OR contains(l, 'kazanç'))::INT + (contains(l, 'because') OR contains(l, 'since'))::INT + (contains(l, 'sim.') OR contains(l, 'netlist.'))::INT + contains(l, '```')::INT + contains(l, 'sweep')::INT + contains(l, 'limit')::INT AS flags FROM s""",
    "eval_dry_run_counts": "SELECT category, difficulty, count(*) AS count FROM eval_task GROUP BY ALL",
    "eval_training_hours": "SELECT p_partkey, round(p_size * 4 * 15 * 3.0::DOUBLE / 3600 / 8, 6) AS hours FROM part",
}
