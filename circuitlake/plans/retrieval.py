"""Retrieval queries over the tasks' specifications and the demo records."""

from __future__ import annotations

from pyspark.sql import functions as F

from circuitlake.operators import retrieval as ret
from circuitlake.operators import scoring
from circuitlake.runtime import table


def _specs(spark, d):
    return scoring.explode_specs(table(spark, d, "eval_task")).select(F.col("task_id").alias("task"), "spec", "low", "high", "target")


def _pairs(spark, d):
    return ret.similarity(_specs(spark, d), _specs(spark, d))


def top(spark, d):
    return ret.top_similar(_pairs(spark, d), 5).select("task", "other", "rank", F.round("similarity", 6).alias("similarity"))


def prune(spark, d):
    rows = table(spark, d, "demo_output").filter("id is not null")
    memory = rows.groupBy("id").agg(F.max("success").alias("success"), F.max("score").alias("score"))
    chars = F.length("id") * 40 + F.coalesce(F.round("score", 2) * 100, F.lit(7)).cast("int")
    return ret.prune(memory.withColumn("cost", ret.token_cost(chars)), 20_000).select("id", "cost")


def topologies(spark, d):
    s = _specs(spark, d).withColumn("v", F.coalesce("low", "target", "high"))
    pick = lambda *names: F.coalesce(*[F.max(F.when(F.col("spec") == n, F.col("v"))) for n in names])
    wants = s.groupBy("task").agg(pick("dc_gain").alias("gain"), (pick("ugb", "bw") * 1e6).alias("ugb"), pick("swing", "vout").alias("swing"))
    tasks = table(spark, d, "eval_task").select(F.col("id").alias("task"), (F.col("category") == "digital").alias("digital"))
    return ret.suggest_topology(tasks.join(wants, "task", "left"))


QUERIES = {
    "retrieval_similarity": lambda spark, d: _pairs(spark, d).select("task", "other", F.round("similarity", 6).alias("similarity")),
    "retrieval_top": top,
    "retrieval_prune": prune,
    "retrieval_topologies": topologies,
}

_S = "s AS (SELECT task, e.key AS spec, e.value.min AS low, e.value.max AS high, e.value.target AS target FROM (SELECT id AS task, unnest(map_entries(specs)) AS e FROM eval_task))"


def _close(c: str) -> str:
    a, b = f"x.{c}", f"y.{c}"
    return f"""CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {a} = {b} THEN 1 WHEN {a} <= 0 OR {b} <= 0 THEN greatest(0, 1 - abs({a} - {b}) / greatest(abs({a}), abs({b}))) ELSE greatest(0, 1 - abs(log10({a} / {b}))) END"""


_P = f"""{_S}, n AS (SELECT task, count(DISTINCT spec) AS n FROM s GROUP BY 1),
  j AS (SELECT x.task, y.task AS other, {_close("low")} AS a, {_close("high")} AS b, {_close("target")} AS c FROM s x JOIN s y ON x.spec = y.spec AND x.task <> y.task),
  g AS (SELECT task, other, count(*) AS shared, sum((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT) AS k, sum(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) AS t FROM j GROUP BY ALL),
  p AS (SELECT g.task, g.other, shared / (u.n + v.n - shared)::DOUBLE AS names, k, t FROM g JOIN n u ON u.task = g.task JOIN n v ON v.task = g.other),
  sim AS (SELECT task, other, CASE WHEN k > 0 THEN 0.5 * names + 0.5 * t / k ELSE names END AS similarity FROM p)"""

SQL = {
    "retrieval_similarity": f"WITH {_P} SELECT task, other, round(similarity, 6) AS similarity FROM sim",
    "retrieval_top": f"WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(similarity, 9) DESC, other) AS rank FROM sim WHERE similarity >= 0.1) SELECT task, other, rank, round(similarity, 6) AS similarity FROM r WHERE rank <= 5",
    "retrieval_prune": """WITH m AS (SELECT id, max(success) AS success, max(score) AS score FROM demo_output WHERE id IS NOT NULL GROUP BY id), c AS (SELECT *, greatest(1, (length(id) * 40 + coalesce(trunc(round(score, 2) * 100), 7)::INT) // 4)::BIGINT AS cost FROM m),
  w AS (SELECT *, sum(cost) OVER () - coalesce(sum(cost) OVER (ORDER BY coalesce(success, false), coalesce(score, 0), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM c)
SELECT id, cost FROM w WHERE rest <= 20000""",
    "retrieval_topologies": f"""WITH {_S}, v AS (SELECT task, spec, coalesce(low, target, high) AS v FROM s),
  w AS (SELECT task, max(v) FILTER (spec = 'dc_gain') AS gain, coalesce(max(v) FILTER (spec = 'ugb'), max(v) FILTER (spec = 'bw')) * 1e6 AS ugb, coalesce(max(v) FILTER (spec = 'swing'), max(v) FILTER (spec = 'vout')) AS swing FROM v GROUP BY 1),
  o(pos, topology, g, s, w) AS (VALUES (0, 'telescopic_cascode', 70.0, 1.0, 0.3), (1, 'folded_cascode', 65.0, 0.7, 0.6), (2, 'two_stage_ota', 80.0, 0.4, 0.9), (3, 'common_source', 30.0, 0.8, 0.7)),
  a AS (SELECT t.id AS task, topology, pos, CASE WHEN gain IS NULL THEN 0 WHEN o.g >= gain THEN 2 ELSE -3 END + CASE WHEN ugb IS NULL THEN 0 ELSE o.s * CASE WHEN ugb >= 50e6 THEN 2 ELSE 1 END END + CASE WHEN swing IS NULL THEN 0 ELSE o.w END AS score
        FROM eval_task t LEFT JOIN w ON w.task = t.id CROSS JOIN o WHERE t.category <> 'digital')
SELECT task, row_number() OVER (PARTITION BY task ORDER BY round(score::DOUBLE, 9) DESC, pos)::INT AS rank, topology FROM a
UNION ALL SELECT id, unnest([1, 2, 3]), unnest(['pipelined', 'fsm', 'combinational']) FROM eval_task WHERE category = 'digital'""",
}
