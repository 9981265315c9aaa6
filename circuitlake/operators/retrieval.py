"""Retrieval of similar tasks by their specifications, budgets and rule-scored rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from circuitlake.runtime import cut

# Candidate topologies with the gain in dB, speed and swing they reach.
TOPOLOGIES = (
    ("telescopic_cascode", 70.0, 1.0, 0.3),
    ("folded_cascode", 65.0, 0.7, 0.6),
    ("two_stage_ota", 80.0, 0.4, 0.9),
    ("common_source", 30.0, 0.8, 0.7),
)
DIGITAL = ("pipelined", "fsm", "combinational")


def closeness(a: Column, b: Column) -> Column:
    """1 for equal numbers, less by the decades apart; linear where one is not positive."""
    span = F.greatest(F.abs(a), F.abs(b))
    return (
        F.when(a == b, 1.0)
        .when((a <= 0) | (b <= 0), F.greatest(F.lit(0.0), 1.0 - F.abs(a - b) / F.when(span == 0, 1.0).otherwise(span)))
        .otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(F.log10(F.when((a > 0) & (b > 0), a / b)))))
    )


def similarity(queries: DataFrame, library: DataFrame) -> DataFrame:
    """(task, other, similarity) of specs (task, spec, low, high, target) against a library.

    Half the Jaccard index of spec names, half the mean closeness of bounds both have; the
    index alone when no bound is shared; pairs without a common name have similarity 0 and
    no row. Pairs come from an equi-join on the name, never from all pairs.
    """
    sizes_q = queries.groupBy("task").agg(F.countDistinct("spec").alias("nq"))
    sizes_l = library.groupBy("task").agg(F.countDistinct("spec").alias("nl")).withColumnRenamed("task", "other")
    q = queries.select("task", "spec", *[F.col(c).alias(f"q_{c}") for c in ("low", "high", "target")])
    o = library.select(F.col("task").alias("other"), "spec", *[F.col(c).alias(f"o_{c}") for c in ("low", "high", "target")])
    both = q.join(o, "spec").filter("task <> other")
    parts = F.array_compact(F.array(*[F.when(F.col(f"q_{c}").isNotNull() & F.col(f"o_{c}").isNotNull(), closeness(F.col(f"q_{c}"), F.col(f"o_{c}"))) for c in ("low", "high", "target")]))
    total = F.aggregate(parts, F.lit(0.0), lambda x, y: x + y)
    agg = both.select("task", "other", F.size(parts).alias("k"), total.alias("t")).groupBy("task", "other").agg(
        F.count(F.lit(1)).alias("shared"), F.sum("k").alias("k"), F.sum("t").alias("t")
    )
    names = F.col("shared") / (F.col("nq") + F.col("nl") - F.col("shared"))
    value = F.when(F.col("k") > 0, 0.5 * names + 0.5 * F.col("t") / F.col("k")).otherwise(names)
    return agg.join(sizes_q, "task").join(sizes_l, "other").select("task", "other", value.alias("similarity"))


def top_similar(pairs: DataFrame, k: int, least: float = 0.1) -> DataFrame:
    """The k best of each task above the threshold (a top-k report), ties by name."""
    w = Window.partitionBy("task").orderBy(F.round("similarity", 9).desc(), "other")
    return pairs.filter(F.col("similarity") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def token_cost(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / 4)).cast("long")


def prune(memory: DataFrame, budget: int, buckets: int = 1024) -> DataFrame:
    """Kept rows of memory (id, success, score, cost): the least useful go first (failures, then
    low scores, then id) until the rest costs at most the budget; a budget of 0 or less keeps none.

    Costs are summed per score bucket first, so the running sum is exact without sorting
    everything in one task: only rows of one bucket are sorted together.
    """
    if budget <= 0:
        return memory.limit(0)
    key = F.struct(F.coalesce("success", F.lit(False)).cast("int").alias("s"), F.coalesce("score", F.lit(0.0)).alias("v"), "id")
    bounds = memory.agg(F.min(F.coalesce("score", F.lit(0.0))).alias("lo"), F.max(F.coalesce("score", F.lit(0.0))).alias("hi"), F.sum("cost").alias("total")).first()
    if bounds["total"] is None or bounds["total"] <= budget:
        return memory
    span = max(bounds["hi"] - bounds["lo"], 1e-12)
    place = F.least(F.floor((F.coalesce("score", F.lit(0.0)) - bounds["lo"]) / span * buckets), F.lit(buckets - 1))
    rows = memory.withColumn("_k", key).withColumn("_b", F.coalesce("success", F.lit(False)).cast("long") * buckets + place)
    sums = rows.groupBy("_b").agg(F.sum("cost").alias("_c"))
    sums = sums.select("_b", (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).alias("_before"))  # 2 * buckets rows at most
    own = Window.partitionBy("_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("cost").over(own), F.lit(0))).join(F.broadcast(cut(sums)), "_b")
    dropped = bounds["total"] - (F.col("_before") + F.col("_own")) > budget
    return rows.filter(~dropped).select(*memory.columns)


def suggest_topology(tasks: DataFrame) -> DataFrame:
    """(task, rank, topology) of tasks (task, digital, gain, ugb, swing), nulls for what a task does not ask.

    Digital tasks get the digital list; enough gain scores 2, too little -3; speed counts
    double from 50 MHz on; the conventional order stands when nothing is asked.
    """
    spark = tasks.sparkSession
    options = F.broadcast(spark.createDataFrame([(i, *t) for i, t in enumerate(TOPOLOGIES)], "pos int, topology string, g double, s double, w double"))  # 4 rows
    score = (
        F.when(F.col("gain").isNull(), 0.0).when(F.col("g") >= F.col("gain"), 2.0).otherwise(-3.0)
        + F.when(F.col("ugb").isNull(), 0.0).otherwise(F.col("s") * F.when(F.col("ugb") >= 50e6, 2.0).otherwise(1.0))
        + F.when(F.col("swing").isNull(), 0.0).otherwise(F.col("w"))
    )
    w = Window.partitionBy("task").orderBy(F.col("score").desc(), "pos")
    analog = tasks.filter(~F.col("digital")).crossJoin(options).withColumn("score", F.round(score, 9))
    analog = analog.select("task", F.row_number().over(w).alias("rank"), "topology")
    digital = tasks.filter("digital").select("task", F.posexplode(F.array(*[F.lit(t) for t in DIGITAL])).alias("p", "topology"))
    return analog.unionByName(digital.select("task", (F.col("p") + 1).alias("rank"), "topology"))


def context(tasks: DataFrame, neighbours: DataFrame, k: int = 3, least: float = 0.1) -> DataFrame:
    """(task, context): the process notes of tasks (task, notes) and their k most similar past
    designs among neighbours (task, other, similarity, success, score); says so if there are none."""
    best = top_similar(neighbours, k, least)
    outcome = F.when(F.coalesce("success", F.lit(False)), "met its specs").otherwise("missed its specs")
    line = F.format_string("- %s: similarity %.2f, %s, score %.3f", "other", "similarity", outcome, F.coalesce("score", F.lit(0.0)))
    listed = best.select("task", F.struct("rank", line.alias("line")).alias("l")).groupBy("task").agg(F.array_sort(F.collect_list("l")).alias("l"))  # k entries at most
    past = F.concat(F.lit("## Past designs\n"), F.coalesce(F.array_join(F.col("l.line"), "\n"), F.lit("none in memory")))
    notes = F.when(F.trim("notes") != "", F.concat(F.lit("## Process\n"), F.trim("notes")))
    return tasks.join(listed, "task", "left").select("task", F.concat_ws("\n\n", notes, past).alias("context"))


def assemble(sections: list[Column], budget: int) -> Column:
    """A prompt of sections in order of priority, blank ones left out: the last ones are dropped
    until the estimated tokens are within the budget; the first one always stays."""
    parts = F.filter(F.array(*sections), lambda s: s.isNotNull() & (s != ""))
    tries = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "\n\n"))
    fitting = F.filter(tries, lambda t: token_cost(F.length(t)) <= budget)
    return F.when(F.size(parts) > 0, F.coalesce(F.try_element_at(fitting, F.lit(-1)), F.element_at(parts, 1))).otherwise("")
