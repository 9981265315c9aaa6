"""Native signal operators against brute force, with small blocks so that stitching is exercised."""

import math
import random

import pytest
from pyspark.sql import functions as F

from circuitlake.operators import signals as sig


@pytest.fixture(scope="module")
def waves(spark):
    random.seed(1)
    rows = []
    for run in range(4):
        x = 0.0
        for _ in range(60):
            x += random.choice([0.3, 1.0, 7.5])
            rows.append((run, x, random.choice([float("nan"), 1.0, 2.0, 3.0]) if run == 3 else random.uniform(-5, 5)))
    return rows, spark.createDataFrame(rows, "run int, x double, y double")


@pytest.mark.parametrize("width, steps", [(2.0, 1), (1000.0, 1), (3.0, 2), (1.0, 3)])
def test_next_sample_across_blocks(waves, width, steps):
    rows, df = waves
    got = {(r.run, r.x): (r.x1, r.y1) for r in sig.with_next(df, width, steps).collect()}
    for run in range(4):
        own = sorted(r for r in rows if r[0] == run)
        for i, (_, x, _) in enumerate(own):
            want = own[i + steps][1:] if i + steps < len(own) else (None, None)
            assert got[(run, x)][0] == want[0]


def test_crossings_match_brute_force(waves):
    rows, df = waves
    got = sorted((r.run, round(r.x_at, 9), r.falling) for r in sig.crossings(sig.with_next(df, 2.0), 1.5).collect())
    want = []
    for run in range(4):
        own = sorted(r[1:] for r in rows if r[0] == run)
        for (x0, y0), (x1, y1) in zip(own, own[1:], strict=False):
            if not math.isnan(y0) and not math.isnan(y1) and min(y0, y1) <= 1.5 <= max(y0, y1) and y0 != y1:
                want.append((run, round(x0 + (1.5 - y0) / (y1 - y0) * (x1 - x0), 9), y0 > y1))
    assert got == sorted(want)


def test_row_order_does_not_matter(waves):
    rows, df = waves
    shuffled = df.orderBy(F.rand(3))
    flat = lambda d: [x for r in sorted(map(tuple, sig.summarize(d).collect())) for x in r]
    assert flat(df) == pytest.approx(flat(shuffled))


def test_unwrap_keeps_half_turns(spark):
    df = spark.createDataFrame([(1, float(i), p) for i, p in enumerate([170.0, -170.0, -150.0, 30.0, float("nan"), 210.0])], "run int, x double, y double")
    got = [r.phase for r in sig.unwrap(df, 2.0).orderBy("x").collect()]
    assert got[:4] == [170.0, 190.0, 210.0, 390.0] and math.isnan(got[4]) and got[5] == 570.0


def test_empty_and_single_samples(spark):
    empty = spark.createDataFrame([], "run int, x double, y double")
    one = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0)], "run int, x double, y double")
    assert sig.with_next(empty, 1.0).count() == 0 and sig.summarize(empty).count() == 0
    rows = sig.with_next(sig.samples(one, F.col("run"), F.col("x"), F.col("y")), 1.0).collect()
    assert len(rows) == 1 and rows[0].x1 is None
    assert sig.closure(sig.with_next(sig.samples(one, F.col("run"), F.col("x"), F.col("y")), 1.0), 0.0).collect()[0].x_at is None


def test_ranks_and_running_values_across_blocks(spark):
    from circuitlake.operators import ordered

    random.seed(4)
    rows = [(k, i, random.choice([None, 1.0, -2.0, 5.0])) for k in range(3) for i in random.sample(range(100), 40)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    block = F.floor(F.col("i") / 7)
    got = {(r.k, r.i): r for r in ordered.with_running(ordered.with_running(ordered.with_rank(df, "k", ["i"], block), "k", ["i"], block, "v", "s"), "k", ["i"], block, "v", "m", "max").collect()}
    for k in range(3):
        own = sorted(r for r in rows if r[0] == k)
        for n, (_, i, _) in enumerate(own, 1):
            seen = [v for _, _, v in own[:n] if v is not None]
            r = got[(k, i)]
            assert (r["_rank"], r["_n"]) == (n, 40) and r.s == (sum(seen) if seen else None) and r.m == (max(seen) if seen else None)
