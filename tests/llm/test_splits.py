"""Task resolution and grouped splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from circuitlake.llm import splits

from .conftest import ALIAS, TASK

SPELLINGS = ["cs_amp_081", "CS_AMP_081", "cs-amp-81.YAML", " cs_amp__081\t", "Cs Amp 081", "eval/tasks/analog/cs_amp_081.yaml", "cs_amp_081#v15", "cs_amp_081@rev3", "cs_amp_81", "D:\\x\\cs_amp_081.yml"]


@pytest.fixture(scope="module")
def tables(spark):
    tasks = spark.createDataFrame([("cs_amp_081", "analog", "x"), ("tia_025", "analog", None), (None, None, None)], TASK)
    alias = spark.createDataFrame([("old_a_001", "old_b_002"), ("old_b_002", "tia_025"), ("loop_1", "loop_2"), ("loop_2", "loop_1"), ("dead_1", "nowhere_9"), (None, "tia_025"), ("x", None)], ALIAS)
    return tasks, alias


def test_spellings_and_renames(chats, tables):
    rows = [{"id": f"a{i}", "task_id": s} for i, s in enumerate(SPELLINGS)]
    rows += [{"id": "b", "task_id": "Old A 1"}, {"id": "c", "task_id": "loop_1"}, {"id": "d", "task_id": "dead_1"}, {"id": "e", "task_id": None}, {"id": "f", "task_id": " "}, {"id": "g", "task_id": "unknown"}, {"id": None, "task_id": "tia_025"}]
    got = {r.id: r.task_id for r in splits.found(chats(rows), *tables).collect()}
    assert got == {**{f"a{i}": "cs_amp_081" for i in range(len(SPELLINGS))}, "b": "tia_025"}


def test_components_stay_together_and_quotas_hold(chats, tables):
    rows = [{"id": f"hot{i}", "task_id": SPELLINGS[i % len(SPELLINGS)], "success": i % 2 == 0} for i in range(60)]
    rows += [{"id": f"t{i}", "task_id": f"task_{i // 5}"} for i in range(200)] + [{"id": f"n{i}"} for i in range(40)]
    rows += rows[:30]  # delivered again
    got = splits.assign(chats(rows), *tables)
    assert got.count() == 300
    assert got.groupBy("component").agg(F.countDistinct("split").alias("k")).filter("k > 1").count() == 0
    assert {r.split: r.records for r in splits.report(got).collect()} == {"train": 240, "val": 30, "test": 30}
    again = {r.id: r.split for r in splits.assign(chats(rows[::-1]), *tables).collect()}
    assert again == {r.id: r.split for r in got.collect()}


def test_coarse_bundles_lose_nothing(chats, tables):
    rows = [{"id": f"t{i}", "task_id": f"task_{int(i**0.5)}"} for i in range(400)]
    got = splits.assign(chats(rows), *tables, max_bundles=3)
    assert got.count() == 400 and got.select("id").distinct().count() == 400
    assert got.groupBy("component").agg(F.countDistinct("split").alias("k")).filter("k > 1").count() == 0


def test_merged_bundles_keep_labels_and_quotas(chats, tables):
    """Sizes and label shares all differ: merged bundles still meet quotas and share out successes."""
    rows, k = [], 0
    for t in range(60):
        for i in range(3 + t % 29):
            rows.append({"id": f"t{k}", "task_id": f"task_{t}", "success": i * 60 < t * 3})
            k += 1
    got = splits.assign(chats(rows), *tables, max_bundles=8)
    n = {r.split: r.records for r in splits.report(got).collect()}
    assert sum(n.values()) == k and abs(n["val"] - k / 10) < 40 and abs(n["test"] - k / 10) < 40
    assert splits.whole(got).collect()[0].torn == 0


def test_long_chain_of_renames(spark, chats, tables):
    links = spark.createDataFrame([(f"c{i}x", f"c{i + 1}x") for i in range(150)] + [("c150x", "tia_025"), ("la", "lb"), ("lb", "la"), ("lc", "la")], "old_id string, new_id string")
    rows = [{"id": "a", "task_id": "c0x"}, {"id": "b", "task_id": "c149x"}, {"id": "c", "task_id": "la"}, {"id": "d", "task_id": "lc"}]
    assert {(r.id, r.task_id) for r in splits.found(chats(rows), tables[0], links).collect()} == {("a", "tia_025"), ("b", "tia_025")}


def test_hot_task_beyond_a_quota_goes_to_train(chats, tables):
    rows = [{"id": f"h{i}", "task_id": "tia_025"} for i in range(90)] + [{"id": f"n{i}"} for i in range(10)]
    got = {r.component: r.split for r in splits.assign(chats(rows), *tables).select("component", "split").distinct().collect()}
    assert got["task:tia_025"] == "train"


def test_empty_tables(spark, chats, tables):
    assert splits.assign(chats([]), *tables).count() == 0
    assert splits.found(chats([{"id": "a", "task_id": "x"}]), tables[0].limit(0), tables[1].limit(0)).count() == 0


def brute_cost(flow, sizes, counts, shares, quotas):
    whole = np.floor(np.outer(counts, shares) + 1e-9) * sizes[:, None]
    over = np.maximum(0, flow - whole)
    return (np.minimum(over, sizes[:, None]) + 4 * np.maximum(0, over - sizes[:, None])).sum() + 10 * np.maximum(0, flow.sum(0) - quotas).sum()


def test_flow_is_feasible_and_cheapest():
    rng = np.random.default_rng(0)
    shares = np.array([0.5, 0.25, 0.25])
    for _ in range(25):
        sizes, counts = rng.integers(1, 4, 2), rng.integers(1, 3, 2)
        supply = sizes * counts
        quotas = np.floor(shares * supply.sum()).astype(int)
        quotas[0] += supply.sum() - quotas.sum()
        flow = splits.min_cost_flow(supply, sizes, counts, shares, quotas)
        assert (flow.sum(1) == supply).all() and (flow >= 0).all()
        best = min(
            brute_cost(np.array([[a, b, supply[0] - a - b], [c, d, supply[1] - c - d]]), sizes, counts, shares, quotas)
            for a in range(supply[0] + 1) for b in range(supply[0] - a + 1) for c in range(supply[1] + 1) for d in range(supply[1] - c + 1)
        )
        assert brute_cost(flow, sizes, counts, shares, quotas) == best
        whole = splits.round_flow(flow, sizes, counts)
        assert (whole.sum(1) == counts).all() and (whole >= 0).all()
