"""Scoring arithmetic with hand-derived values."""

import pytest
from pyspark.sql import functions as F

from circuitlake.functions import scores
from circuitlake.operators import corpus, evaluation, extraction, retrieval, scoring


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in values.items()]).select(column.alias("r")).collect()[0].r


@pytest.mark.parametrize("actual, low, want", [(60, 60, 0.0), (120, 60, 1.0), (30, 60, -1.0), (600, 60, 1.0), (-5, -10, 1.0), (-15, -10, -1.0)])
def test_minimum(spark, actual, low, want):
    assert one(spark, scores.log_distance_min(F.col("a"), F.col("m")), a=actual, m=low) == pytest.approx(want)


@pytest.mark.parametrize("actual, high, want", [(200, 200, 0.0), (100, 200, 1.0), (400, 200, -1.0), (-20, -80, 1.0), (5, -1, -1.0)])
def test_maximum(spark, actual, high, want):
    assert one(spark, scores.log_distance_max(F.col("a"), F.col("m")), a=actual, m=high) == pytest.approx(want)


def test_target_and_contract(spark):
    t = scores.log_distance_target(F.col("a"), F.col("t"))
    assert one(spark, t, a=1.2, t=1.2) == 1.0 and one(spark, t, a=2.4, t=1.2) == -1.0 and one(spark, t, a=0, t=0) == 1.0 and one(spark, t, a=1, t=-1) is None
    c = scores.contract(F.col("a"), F.col("l"), F.col("h"))
    assert one(spark, c, a=5, l=4, h=None) == 1.0 and one(spark, c, a=3, l=4, h=None) == pytest.approx(-0.415, abs=1e-3) and one(spark, c, a=None, l=4, h=None) == -1.0


def test_missing_result_is_a_row(spark):
    specs = spark.createDataFrame([("t", "gain", 60.0, None, None, 1.0), ("t", "idd", None, 2.0, None, 3.0)], "task_id string, spec string, low double, high double, target double, weight double")
    results = spark.createDataFrame([("t", "gain", 120.0)], "task_id string, spec string, actual double")
    scored = scoring.score_specs(specs, results)
    got = {r.spec: (r.met, r.score) for r in scored.collect()}
    assert got == {"gain": (True, 1.0), "idd": (False, -1.0)}
    assert scoring.weighted_totals(scored, ("task_id",)).collect()[0].total == pytest.approx((1 - 3) / 4)
    assert scoring.coverage(specs, results).collect()[0].coverage == 0.5


def test_corner_modes(spark):
    nominal = spark.createDataFrame([("t", 0.8)], "task_id string, total double")
    corners = spark.createDataFrame([("t", c, v) for c, v in (("ss", 0.2), ("ff", 0.5))], "task_id string, corner string, total double")
    total = lambda m: scoring.corner_total(nominal, corners, m, ("task_id",)).collect()[0].total
    assert total("nominal") == 0.8 and total("worst") == 0.2 and total("weighted") == pytest.approx(0.5)
    runs = spark.createDataFrame([("t", float(i)) for i in range(20)], "task_id string, total double")
    assert scoring.corner_total(runs, runs, "monte_carlo", ("task_id",)).collect()[0].total == 1.0


def test_reward_of_infeasible_and_failed(spark):
    totals = spark.createDataFrame([("a", -1.0, 0, True), ("b", 1.0, 0, False), ("c", 1.0, 10, True)], "task_id string, total double, step int, converged boolean")
    checks = spark.createDataFrame([("a", False, 1.0)], "task_id string, passed boolean, violation double")
    got = {r.task_id: r.reward for r in scoring.reward(totals, checks, ("task_id",), 0.2, 20).collect()}
    assert got["a"] == pytest.approx(-0.05) and got["b"] == -0.5 and got["c"] == pytest.approx(0.9)


def test_extraction_reasons(spark):
    specs = spark.createDataFrame([("t", s, u) for s, u in (("Gain ", "dB"), ("ugb", "MHz"), ("bits", "bits"), ("foo", "V"), ("idd", "V"), ("pm", "deg"), ("noise", "nV/sqrt(Hz)"), ("vout", "mV"))], "task_id string, spec string, unit string")
    metrics = spark.createDataFrame([("t", "passband_gain_db", 60.0, None), ("t", "ugb", 5e6, None), ("t", "phase_margin", None, "no_unity_gain"), ("t", "vout", float("inf"), None)], "task_id string, metric string, si double, note string")
    got = {r.spec: (r.value, r.reason) for r in extraction.extract(specs, metrics).collect()}
    assert got["Gain "] == (60.0, None) and got["ugb"] == (5.0, None) and got["bits"][1] == "non_analog_unit" and got["foo"][1] == "unknown_spec"
    assert got["idd"][1] == "wrong_unit" and got["pm"][1] == "no_unity_gain" and got["noise"][1] == "no_noise_kind" and got["vout"][1] == "not_finite"


def test_similarity_is_symmetric_and_prune_keeps_the_best(spark):
    s = spark.createDataFrame([("a", "gain", 60.0, None, None), ("b", "gain", 600.0, None, None), ("a", "x", 1.0, None, None), ("c", "other", 1.0, None, None)], "task string, spec string, low double, high double, target double")
    got = {(r.task, r.other): r.similarity for r in retrieval.similarity(s, s).collect()}
    assert got[("a", "b")] == got[("b", "a")] == pytest.approx(0.25) and ("a", "c") not in got
    memory = spark.createDataFrame([(1, False, 0.9, 10), (2, True, 0.1, 10), (3, True, 0.8, 10), (4, None, None, 10)], "id int, success boolean, score double, cost long")
    assert sorted(r.id for r in retrieval.prune(memory, 20).collect()) == [2, 3]
    assert retrieval.prune(memory, 0).count() == 0 and retrieval.prune(memory, 100).count() == 4


def test_splits_have_exact_counts(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in range(300)] + [(900, None)], "id int, source string")
    got = corpus.stratified_split(rows, "source", F.col("id"))
    assert {(r.source, r.split): r["count"] for r in got.groupBy("source", "split").count().collect()} == {("hot", "val"): 20, ("hot", "train"): 180, ("cold", "val"): 10, ("cold", "train"): 90, (None, "train"): 1}
    assert corpus.hash_split(rows, F.col("id"), 0.9).filter("split = 'train'").count() == 270
    assert corpus.prepare(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_movers_and_html(spark):
    a = spark.createDataFrame([("x", True, 0.5), ("y", False, 0.1)], "task string, passed boolean, score double")
    b = spark.createDataFrame([("x", False, 0.2), ("z", True, 0.9)], "task string, passed boolean, score double")
    got = {r.task: (r.flip, r.missing) for r in evaluation.task_changes(a, b).collect()}
    assert got == {"x": ("down", None), "y": (None, "second"), "z": (None, "first")}
    assert [r.task for r in evaluation.movers(evaluation.task_changes(a, b)).collect()] == ["x"]
    html = evaluation.html_report(spark.createDataFrame([("<a>", "easy", True), ("<a>", "easy", False)], "category string, difficulty string, passed boolean"))
    assert "&lt;a&gt;" in html and "50%" in html
