"""Signal choice, pairing, noise, stability and seeded generation on literals."""

import math

import pytest
from pyspark.sql import functions as F

from circuitlake.operators import results as res


def test_pick_signal(spark):
    df = spark.createDataFrame([(1, "v(a)"), (1, "v(out)"), (2, "i#branch"), (2, "v(n1)"), (3, "x#branch")], "run int, name string")
    assert {r.run: r.name for r in res.pick_signal(df).collect()} == {1: "v(out)", 2: "v(n1)", 3: None}
    assert {r.run: r.name for r in res.pick_signal(df, names=res.INPUTS, fallback=False).collect()} == {1: None, 2: None, 3: None}
    assert {r.run: r.name for r in res.pick_signal(df, wanted="v(a)").collect()}[1] == "v(a)"


def test_pairing(spark):
    rows = [(1, "vdb(out)", 1.0, 3.0), (1, "vdb(out)", 2.0, 4.0), (1, "vp(out)", 1.0, -9.0), (1, "vp(out)", 2.0, -10.0), (1, "VDB(b)", 1.0, 1.0), (1, "VP(b)", 1.0, 2.0), (1, "VP(b)", 5.0, 2.0), (1, "time", 0.0, 0.0)]
    got = {(r.node, r.x): (r.gain_db, r.phase_deg) for r in res.pair_responses(spark.createDataFrame(rows, "run int, name string, x double, y double")).collect()}
    assert got == {("out", 1.0): (3.0, -9.0), ("out", 2.0): (4.0, -10.0), ("b", 1.0): (1.0, None)}
    a = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 1.0), (2, 0.0, 1.0)], "run int, x double, y double")
    b = spark.createDataFrame([(1, 1.0, 5.0), (1, 0.0, 5.0), (2, 0.5, 1.0)], "run int, x double, y double")
    assert {r.run: r.same_axis for r in res.pair_on_axis(a, b).collect()} == {1: True, 2: False}


def test_deck_guard(spark):
    b = spark.createDataFrame([(1, "v1"), (2, "v1"), (2, "v9")], "run int, name string")
    e = spark.createDataFrame([(1, "v1"), (2, "v1")], "run int, name string")
    assert {r.run: r.belongs for r in res.belongs_to_deck(b, e).collect()} == {1: True, 2: False}


def test_flat_noise_integrates_to_the_root_of_the_band(spark):
    rows = [(1, float(x), 2e-9) for x in range(1, 1002)] + [(2, float(x), 1e-6 / x) for x in range(1, 50)]
    got = {r.run: r for r in res.noise_metrics(spark.createDataFrame(rows, "run int, x double, y double"), 100.0).collect()}
    assert got[1].rms == pytest.approx(2e-9 * math.sqrt(1000)) and got[1].density == 2e-9
    assert got[2].density is None and got[2].reason == "not_flat_at_start"


def test_stability_of_two_poles(spark):
    rows = []
    for i in range(401):
        f = 10 ** (i / 50)
        h = 1e3 / ((1 + 1j * f / 1e3) * (1 + 1j * f / 1e6))
        rows.append((1, f, h.real, h.imag))
    one = [(1, r[1], 1.0, 0.0) for r in rows]
    schema = "run int, x double, re double, im double"
    r = res.stability(spark.createDataFrame(rows, schema), spark.createDataFrame(one, schema)).collect()[0]
    assert r.phase_margin == pytest.approx(52, abs=1.5) and r.gain_margin == math.inf and r.reason is None


def test_seeded_generation(spark):
    p = spark.createDataFrame([("t", "w", 10.0, 9.0, 11.0, False), ("t", "m", 4.0, 1.0, 9.0, True)], "task string, name string, default double, low double, high double, integer boolean")
    a = {r.name: r.value for r in res.jitter(p, 0.5, 1).collect()}
    assert a == {r.name: r.value for r in res.jitter(p.orderBy(F.desc("name")), 0.5, 1).collect()}
    assert 9 <= a["w"] <= 11 and a["m"] == int(a["m"])
    assert res.monte_carlo_grid(p, 5, 3).count() == 10 and res.attempts(p, 4).count() == 8
    with pytest.raises(ValueError):
        res.monte_carlo_grid(p, 0, 3)
    t = res.scripted_trajectory(spark.createDataFrame([("a", "do", "n", "ok")], "id string, request string, netlist string, result string"), "p").collect()[0]
    assert [m.role for m in t.messages] == ["system", "user", "assistant", "tool", "assistant"] and "sim.ac" in t.messages[2].content
    g = res.grounded_specs(spark.createDataFrame([(1, 0, "gain", 60.0, True), (1, 1, "idd", 2.0, False), (1, 3, "x", 1.0, True)], "run int, pos int, name string, value double, larger_is_better boolean"), 1).collect()
    assert len(g) == 2 and all((r.low or 0) < 60 and (r.high is None or r.high > 2) for r in g)
    d = res.features(spark.createDataFrame([("t\nM1 a b c d n W=1.5u L=1u\nX2 a b w=500n\nR1 a b 1k",)], "text string")).collect()[0]
    assert d.total_width == pytest.approx(2e-6) and d.devices == 2
