"""Numerical search over bounded parameters, as rounds of DataFrames of candidates."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circuitlake.runtime import cut


class Optimizer(ABC):
    """Proposes candidates (task, name, value, candidate) from bounds (task, name, low, high) and
    what was scored so far (task, candidate, name, value, score)."""

    @abstractmethod
    def suggest_next(self, bounds: DataFrame, history: DataFrame | None, number: int) -> DataFrame: ...

    def optimize(self, bounds: DataFrame, evaluate: Callable[[DataFrame], DataFrame], rounds: int = 4) -> DataFrame:
        """The best candidate of every task, one row a parameter; evaluate adds `score`, equal for
        all parameters of a candidate. A null score is the worst."""
        history = None
        for number in range(rounds):
            scored = evaluate(self.suggest_next(bounds, history, number)).select("task", "candidate", "name", "value", "score")
            history = cut(scored if history is None else best(history).unionByName(scored))
        return best(history)


def best(history: DataFrame) -> DataFrame:
    """All parameters of each task's best candidate; ties go to the first one in name."""
    top = history.groupBy("task").agg(F.min_by("candidate", F.struct(-F.coalesce("score", F.lit(float("-inf"))), "candidate")).alias("candidate"))
    return history.join(top, ["task", "candidate"]).select("task", "candidate", "name", "value", "score")


class Shrinking(Optimizer):
    """Candidates differ from the best one so far in one parameter at a time: `points` values across
    a range that shrinks by `factor` once there were as many rounds as parameters, so that each
    may move; the first round starts in the middle."""

    def __init__(self, points: int = 9, factor: float = 0.35):
        self.points, self.factor = points, factor

    def suggest_next(self, bounds: DataFrame, history: DataFrame | None, number: int) -> DataFrame:
        if history is None:
            centre = bounds.withColumn("centre", (F.col("low") + F.col("high")) / 2)
        else:
            centre = bounds.join(best(history).select("task", "name", F.col("value").alias("centre")), ["task", "name"])
        moves = centre.select("task", F.col("name").alias("moved"), F.explode(F.sequence(F.lit(0), F.lit(self.points - 1))).alias("i"))
        rows = moves.join(centre, "task")
        parameters = bounds.groupBy("task").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
        reach = (F.col("high") - F.col("low")) * self.factor ** (number // parameters) / 2
        at = F.greatest(F.col("low"), F.least(F.col("high"), F.col("centre") + reach * (2.0 * F.col("i") / max(1, self.points - 1) - 1)))
        value = F.when(F.col("name") == F.col("moved"), at).otherwise(F.col("centre"))
        name = F.format_string("%02d-%s-%03d", F.lit(number), "moved", "i")
        return rows.select("task", name.alias("candidate"), "name", value.alias("value"))
