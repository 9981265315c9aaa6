"""Evaluation runs: metrics, groupings, comparisons, behaviour, ranks and replayed rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from circuitlake.operators import ordered
from circuitlake.runtime import bounded_rows

#: Steps or trials in one window group; windows by whole run are left to episodes, whose length is bounded.
BLOCK = 4096


def metrics(results: DataFrame, by: str) -> DataFrame:
    """Per run of results (run, passed, score, steps, seconds, error): pass rate, means, spread.

    mean_steps_passed counts passed rows only, mean_steps all; efficiency is the sum of
    scores over the sum of steps (steps > 0); the deviation of one row is 0.
    """
    passed = F.coalesce("passed", F.lit(False))
    return results.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(passed).alias("passed"),
        F.avg(passed.cast("double")).alias("pass_rate"),
        F.avg("score").alias("mean_score"),
        F.coalesce(F.avg(F.when(passed, F.col("steps"))), F.lit(0.0)).alias("mean_steps_passed"),
        F.avg("steps").alias("mean_steps"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("steps") > 0, F.col("score"))), F.sum(F.when(F.col("steps") > 0, F.col("steps")))), F.lit(0.0)).alias("efficiency"),
        F.median("score").alias("median_score"),
        F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.sum("seconds").alias("seconds"),
        F.count("error").alias("errors"),
    )


def grouped_rates(results: DataFrame) -> DataFrame:
    """Pass rate and mean score overall, per category and per difficulty, as grouping sets."""
    return results.sparkSession.sql(
        """SELECT category, difficulty, grouping_id(category, difficulty) AS level, count(*) AS n,
                  avg(CAST(coalesce(passed, false) AS DOUBLE)) AS pass_rate, avg(score) AS mean_score
           FROM {rows} GROUP BY GROUPING SETS ((), (category), (difficulty))""",
        rows=results,
    )


def category_means(results: DataFrame, by: str, value: str) -> DataFrame:
    return results.rollup(by).agg(F.grouping(by).alias("is_total"), F.count(value).alias("n"), F.avg(value).alias("mean"))


def compare(one: DataFrame, two: DataFrame) -> DataFrame:
    """Deltas (second minus first) of two one-row aggregates; a cross join of single rows."""
    names = ("pass_rate", "mean_score", "efficiency")
    a = one.select(*[F.col(n).alias(f"a_{n}") for n in names]).limit(1)
    b = two.select(*[F.col(n).alias(f"b_{n}") for n in names]).limit(1)
    return a.crossJoin(b).select(*[(F.col(f"b_{n}") - F.col(f"a_{n}")).alias(f"delta_{n}") for n in names])


def task_difference(one: DataFrame, two: DataFrame, key: str = "task") -> DataFrame:
    """Tasks only one run has: (task, side)."""
    a, b = one.select(key).distinct(), two.select(key).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("first")).union(b.exceptAll(a).withColumn("side", F.lit("second")))


def task_changes(one: DataFrame, two: DataFrame, key: str = "task") -> DataFrame:
    """Full outer join of two runs (task, passed, score): delta, flip (up, down or null), missing side."""
    a = one.select(key, F.col("passed").alias("pa"), F.col("score").alias("sa"))
    b = two.select(key, F.col("passed").alias("pb"), F.col("score").alias("sb"))
    flip = F.when(~F.col("pa") & F.col("pb"), "up").when(F.col("pa") & ~F.col("pb"), "down")
    missing = F.when(F.col("sa").isNull(), "first").when(F.col("sb").isNull(), "second")
    return a.join(b, key, "full_outer").select(key, "sa", "sb", (F.col("sb") - F.col("sa")).alias("delta"), flip.alias("flip"), missing.alias("missing"))


def movers(changes: DataFrame, k: int = 8, key: str = "task") -> DataFrame:
    """The k largest absolute deltas beyond 1e-9 (a top-k report)."""
    return changes.filter(F.abs("delta") > 1e-9).orderBy(F.abs("delta").desc(), key).limit(k)


def behaviour(turns: DataFrame) -> DataFrame:
    """Per run of turns (run, turn, tool, values): calls, distinct tools, measured values, stuck.

    Stuck: three or more calls, all of the same tool.
    """
    return turns.groupBy("run").agg(
        F.count("tool").alias("calls"),
        F.countDistinct("tool").alias("tools"),
        F.coalesce(F.sum("values"), F.lit(0)).cast("long").alias("measured"),
        ((F.count("tool") >= 3) & (F.countDistinct("tool") == 1)).alias("stuck"),
    )


def stuck_turns(turns: DataFrame, last: int = 3) -> DataFrame:
    """Turns whose tool equals those of the `last - 1` calls before; turns without a tool never are."""
    w = Window.partitionBy("run").orderBy("turn")
    same = F.col("tool").isNotNull()
    for k in range(1, last):
        same = same & F.coalesce(F.lag("tool", k).over(w) == F.col("tool"), F.lit(False))
    return turns.withColumn("is_stuck", same).filter("is_stuck").select("run", "turn", "tool")


def retry_strategy(turns: DataFrame, max_repeats: int = 3) -> DataFrame:
    """(run, turn, strategy) from turns (run, turn, tool, score, shortfall): the next move after each turn.

    change_topology after `max_repeats` equal tools in a row or a shortfall beyond one
    decade; same_approach if the score rose; escalate if the last of four or more scores is
    no better than each of the three before; else modify_params.
    """
    w = Window.partitionBy("run").orderBy("turn")
    repeated = F.col("tool").isNotNull()
    for k in range(1, max_repeats):
        repeated = repeated & F.coalesce(F.lag("tool", k).over(w) == F.col("tool"), F.lit(False))
    before = F.lag("score").over(w)
    floor = F.min("score").over(w.rowsBetween(-3, -1))
    n = F.count("score").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    strategy = (
        F.when(repeated | F.coalesce(F.col("shortfall") > 1.0, F.lit(False)), "change_topology")
        .when(F.col("score") > before, "same_approach")
        .when((n >= 4) & (F.col("score") <= floor), "escalate")
        .otherwise("modify_params")
    )
    return turns.select("run", "turn", strategy.alias("strategy"))


def group_ranks(rollouts: DataFrame, size: int = 4) -> DataFrame:
    """Rank and advantage 1 - 2 (rank) / (size - 1) by reward in each group, ties by i; plus best, worst, spread."""
    w = Window.partitionBy("grp").orderBy(F.col("reward").desc(), "i")
    g = Window.partitionBy("grp")
    rank = F.row_number().over(w) - 1
    return rollouts.select(
        "grp", "i", "reward", rank.alias("rank"), (1 - 2 * rank / F.lit(float(size - 1))).alias("advantage"),
        F.max("reward").over(g).alias("best"), F.min("reward").over(g).alias("worst"), (F.max("reward").over(g) - F.min("reward").over(g)).alias("spread"),
    )


def throughput(rows: DataFrame, by: str) -> DataFrame:
    """Mean of rates against ratio of sums of rows (amount, seconds)."""
    return rows.groupBy(by).agg(F.avg(F.try_divide("amount", "seconds")).alias("mean_of_rates"), F.try_divide(F.sum("amount"), F.sum("seconds")).alias("ratio_of_sums"))


def loss_summary(logs: DataFrame, by: str) -> DataFrame:
    """First, last and least loss by step and the reduction in percent; equal rows of several checkpoints count once."""
    rows = logs.select(by, "step", "loss").distinct()
    first, last = F.min_by("loss", F.struct("step", "loss")), F.max_by("loss", F.struct("step", "loss"))
    agg = rows.groupBy(by).agg(first.alias("first"), last.alias("last"), F.min("loss").alias("least"), F.max("step").alias("last_step"))
    return agg.withColumn("reduction_pct", F.try_divide((F.col("first") - F.col("last")) * 100, F.col("first")))


def step_rewards(steps: DataFrame, step_penalty: float = 0.005) -> DataFrame:
    """Rewards of steps (run, step, tool, ok, score, passed): replay of the environment's rule.

    reward is what the history holds; the extra penalty of a failed simulation is in it but
    not in `counted`, from which the running total is made.
    """
    sim = F.startswith("tool", F.lit("sim."))
    counted = (
        F.lit(-step_penalty)
        + F.when(sim & F.col("ok"), 0.02).otherwise(0.0)
        + F.when((F.col("tool") == "sim.corners") & F.col("ok"), 0.05).otherwise(0.0)
        + F.when((F.col("tool") == "spec.check") & F.col("ok"), 0.5 * F.coalesce("score", F.lit(0.0)) + F.when(F.coalesce("passed", F.lit(False)), 1.0).otherwise(0.0)).otherwise(0.0)
    )
    rows = ordered.with_running(steps.withColumn("counted", counted), "run", ["step"], F.floor(F.col("step") / BLOCK), "counted", "total")
    reward = F.col("counted") - F.when(sim & ~F.col("ok"), 0.1).otherwise(0.0)
    return rows.select("run", "step", "tool", reward.alias("reward"), "total")


def running_best(trials: DataFrame, cap: int) -> DataFrame:
    """Best score so far of trials (run, i, score) up to `cap` trials a run; a failed trial (null
    score) counts -1e6, NaN minus infinity. The cap is the optimiser's evaluation budget."""
    value = F.when(F.col("score").isNull(), F.lit(-1e6)).when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    block = F.floor(F.col("i") / BLOCK)
    rows = ordered.with_rank(trials.withColumn("value", value), "run", ["i"], block).filter(F.col("_rank") <= cap)
    return ordered.with_running(rows, "run", ["i"], block, "value", "best", "max").select("run", "i", "best")


def training_hours(episodes: Column, generations: Column, workers: Column, seconds_per_sim: float = 3.0, sims: int = 15) -> Column:
    return episodes * generations * sims * seconds_per_sim / 3600 / workers


def response_score(response: Column, keywords: list[str], tools: list[str]) -> Column:
    """0.4 keywords + 0.2 tools + 0.2 length (words / 100) + 0.2 structure (code, explanation)."""
    low = F.lower(response)
    hits = sum((F.contains(low, F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
    found = sum((F.contains(response, F.lit(t)).cast("int") for t in tools), F.lit(0))
    keyword = hits / len(keywords) if keywords else F.lit(1.0)
    tool = found / len(tools) if tools else F.when(F.contains(response, F.lit("<tool_call>")), 0.5).otherwise(1.0)
    stripped = F.regexp_replace(response, r"^\s+|\s+$", "")
    words = F.when(stripped == "", 0).otherwise(F.size(F.split(stripped, r"\s+")))
    code = F.contains(response, F.lit("```")) | F.contains(response, F.lit(".model")) | F.contains(response, F.lit("module"))
    why = low.rlike("because|since|therefore|strategy|approach")
    structure = 0.5 * code.cast("int") + 0.5 * why.cast("int")
    return 0.4 * keyword + 0.2 * tool + 0.2 * F.least(F.lit(1.0), words / 100) + 0.2 * structure


def flag_score(text: Column, groups: list[list[str]]) -> Column:
    """How many groups have any of their words in the text."""
    low = F.lower(text)
    return sum((F.exists(F.array(*[F.lit(w) for w in g]), lambda k: F.contains(low, k)).cast("int") for g in groups), F.lit(0))


def html_report(results: DataFrame) -> str:
    """HTML table of pass rates by category and difficulty: small aggregates only reach the driver."""
    rows = results.groupBy("category", "difficulty").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("p")).orderBy("category", "difficulty")
    from html import escape

    lines = []
    for r in bounded_rows(rows, 10_000, "the report"):  # groups of two closed vocabularies
        pct = r["p"] * 100 // r["n"]
        cells = "".join(f"<td>{escape(str(x))}</td>" for x in (r["category"], r["difficulty"], r["n"], f"{pct}%"))
        lines.append(f'<tr>{cells}<td><div style="width:{max(0, min(100, pct))}px"></div></td></tr>')
    return "<table>" + "".join(lines) + "</table>"


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """Rows per status, as template checks report them."""
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def agent_totals(replies: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Summed tokens and seconds of agent replies (*by, tokens, seconds)."""
    return replies.groupBy(*by).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))
