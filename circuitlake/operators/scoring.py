"""Specification scoring: joins of specs and results, corners, Monte Carlo, feasibility, rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circuitlake.functions import scores
from circuitlake.operators import ordered

NON_CONVERGENCE = -0.5
INFEASIBLE_FACTOR = 0.1


def explode_specs(tasks: DataFrame) -> DataFrame:
    """(task_id, spec, low, high, target, weight, unit, at_freq) of tasks with a map of specs."""
    return tasks.select(F.col("id").alias("task_id"), F.explode("specs").alias("spec", "s")).select(
        "task_id", "spec", F.col("s.min").alias("low"), F.col("s.max").alias("high"), F.col("s.target").alias("target"),
        F.coalesce("s.weight", F.lit(1.0)).alias("weight"), F.col("s.unit").alias("unit"), F.col("s.at_freq").alias("at_freq"),
    )


def score_specs(specs: DataFrame, results: DataFrame, keys: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """Left outer join on spec name: a spec without a result scores -1 and is not met.

    results: (*keys, spec, actual). Adds actual, met, score (partial credit), margin_db,
    contract_score and shortfall.
    """
    a, low, high, target = (F.col(c) for c in ("actual", "low", "high", "target"))
    return specs.join(results, [*keys, "spec"], "left").select(
        *keys, "spec", "weight", "low", "high", "target", "actual",
        scores.met(a, low, high, target).alias("met"),
        scores.partial_credit(a, low, high, target).alias("score"),
        scores.margin_db(a, low, high).alias("margin_db"),
        scores.contract(a, low, high).alias("contract_score"),
        scores.shortfall_decades(a, low, high, target).alias("shortfall"),
    )


def weighted_totals(scored: DataFrame, by: tuple[str, ...], score: str = "score") -> DataFrame:
    return scored.groupBy(*by).agg(scores.weighted_mean(F.col(score), F.col("weight")).alias("total"), F.bool_and("met").alias("all_met"))


def corner_total(nominal: DataFrame, corners: DataFrame, mode: str, by: tuple[str, ...]) -> DataFrame:
    """Aggregate nominal totals (*by, total) with corner totals (*by, corner, total).

    mode: nominal, worst (least of all), weighted (plain mean of nominal and corners) or
    monte_carlo (the element at index int(n * 0.05) of the ascending corner totals).
    """
    if mode == "nominal":
        return nominal.select(*by, "total")
    if mode == "monte_carlo":
        # equal totals are counted first; the counts then run over blocks of totals
        counts = corners.groupBy(F.struct(*by).alias("_k"), "total").agg(F.count(F.lit(1)).alias("c"))
        run = ordered.with_running(counts, "_k", ["total"], F.floor(F.col("total") * 1000), "c", "upto")
        n = counts.groupBy("_k").agg(F.sum("c").alias("n"))
        reached = run.join(n, "_k").filter(F.col("upto") >= F.floor(F.col("n") * 0.05) + 1)
        return reached.groupBy("_k").agg(F.min("total").alias("total")).select("_k.*", "total")
    agg = corners.groupBy(*by).agg(F.min("total").alias("worst"), F.sum("total").alias("sum"), F.count("total").alias("n"))
    joined = nominal.join(agg, list(by), "left")
    if mode == "worst":
        return joined.select(*by, F.least("total", "worst").alias("total"))
    if mode == "weighted":
        return joined.select(*by, ((F.col("total") + F.coalesce("sum", F.lit(0.0))) / (1 + F.coalesce("n", F.lit(0)))).alias("total"))
    raise ValueError(f"unknown mode {mode}")


def feasibility(params: DataFrame, constraints: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Violations of hard limits: params (*by, parameter, value) with constraints (name,
    parameter, low, high). Parameters without constraint and constraints without value are
    skipped; with both limits the lower one is reported as `bound`."""
    v, low, high = F.col("value"), F.col("low"), F.col("high")
    ratio = F.when(v < low, (low - v) / F.nullif(low, F.lit(0.0))).when(v > high, (v - high) / F.nullif(high, F.lit(0.0))).otherwise(0.0)
    broken = F.coalesce(v > high, F.lit(False)) | F.coalesce(v < low, F.lit(False))
    return params.filter("value is not null").join(constraints, "parameter").select(
        *by, "name", "parameter", "value", F.coalesce(low, high).alias("bound"), (~broken).alias("passed"), ratio.alias("violation")
    )


def reward(totals: DataFrame, checks: DataFrame, by: tuple[str, ...], step_penalty: float = 0.0, max_steps: int = 20) -> DataFrame:
    """Reward of totals (*by, total, step, converged) with feasibility checks (*by, passed, violation).

    Non-convergence is -0.5. An infeasible design is multiplied by 0.1 / (1 + worst
    violation), whatever the sign of its total. The step penalty comes off at the end.
    """
    worst = checks.groupBy(*by).agg(F.bool_and("passed").alias("feasible"), F.max(F.when(~F.col("passed"), F.col("violation"))).alias("worst"))
    joined = totals.join(worst, list(by), "left")
    factor = F.when(F.coalesce("feasible", F.lit(True)), 1.0).otherwise(INFEASIBLE_FACTOR / (1.0 + F.coalesce("worst", F.lit(0.0))))
    step_cost = F.lit(step_penalty) * F.col("step") / F.lit(max_steps)
    return joined.select(
        *by, F.coalesce("feasible", F.lit(True)).alias("feasible"),
        F.when(~F.col("converged"), F.lit(NON_CONVERGENCE)).otherwise(F.col("total") * factor - step_cost).alias("reward"),
    )


def claims_against_measured(claims: DataFrame, measured: DataFrame, by: tuple[str, ...], tolerance: float = 0.05) -> DataFrame:
    """Claims (*by, spec, claimed) that are not measured or differ by more than the tolerance."""
    gap = F.abs(F.col("claimed") - F.col("measured")) / F.greatest(F.abs("measured"), F.abs("claimed"), F.lit(1e-30))
    joined = claims.join(measured, [*by, "spec"], "left").withColumn("gap", gap)
    kind = F.when(F.col("measured").isNull(), "not_measured").when(F.col("gap") > tolerance, "differs")
    return joined.withColumn("kind", kind).filter("kind is not null").select(*by, "spec", "claimed", "measured", "kind")


def measurable(specs: DataFrame, results: DataFrame, by: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """Specs whose name was measured."""
    return specs.join(results, [*by, "spec"], "left_semi")


def coverage(specs: DataFrame, results: DataFrame, by: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """Measured share of each group's specs; 0 when there are none."""
    marked = specs.join(results.select(*by, "spec", F.lit(1).alias("hit")).distinct(), [*by, "spec"], "left")
    return marked.groupBy(*by).agg(F.coalesce(F.try_divide(F.count("hit"), F.count(F.lit(1))), F.lit(0.0)).alias("coverage"))


def spec_check(extracted: DataFrame, specs: DataFrame, by: tuple[str, ...] = ("task_id",), least: float = 0.95) -> DataFrame:
    """(*by, score, measured, unmeasurable, success) of extracted values (*by, spec, value, reason)
    against specs (*by, spec, low, high, target, weight).

    Only what was measured is scored; a check succeeds if that score reaches `least` and
    nothing was unmeasurable. Specs without any row count as unmeasurable.
    """
    joined = specs.join(extracted.select(*by, "spec", "value"), [*by, "spec"], "left")
    one = scores.contract(F.col("value"), F.col("low"), F.col("high"))
    hit = F.col("value").isNotNull()
    agg = joined.groupBy(*by).agg(
        F.try_divide(F.sum(F.when(hit, F.greatest(one, F.lit(0.0)) * F.col("weight"))), F.sum(F.when(hit, F.col("weight")))).alias("score"),
        F.count_if(hit).alias("measured"), F.count_if(~hit).alias("unmeasurable"),
    )
    score = F.coalesce("score", F.lit(0.0))
    return agg.select(*by, score.alias("score"), "measured", "unmeasurable", ((score >= least) & (F.col("unmeasurable") == 0)).alias("success"))
