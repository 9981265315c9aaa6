"""Contract, deck elements, corners, sizing, checks, context and the entry, on hand-made cases."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from circuitlake import runtime
from circuitlake.functions import unitparse as up
from circuitlake.operators import conversation as conv
from circuitlake.operators import corpus, evaluation, retrieval, scoring
from circuitlake.operators import netlists as net
from circuitlake.operators import results as res
from circuitlake.operators import signals as sig

DECK = """title line
* comment
V1 VDD 0 DC 1.8
X1 a b
+ amp W=1u ; note
.subckt amp a b
Vx b gnd! 0.5
M1 a b 0 0 nch
.ends
.control
V9 fake 0 9
.endc
.end
V8 late 0 8
"""


def column(spark, value, *columns):
    return spark.createDataFrame([(value,)], "text string").select(*columns).collect()[0]


def test_long_units_are_read():
    assert up.parse("V" + " " * 200 + "/ us").dimension == "slew"
    assert up.parse("x" * 5000) is None


def test_contract_and_grammar():
    names = conv.tool_names()
    assert len(names) == 15 and names == sorted(names) and "lint.check" in names and "netlist.lint" not in names
    text = conv.call_grammar(["sim.ac", "sim.dc"])
    assert 'tool ::= "\\"sim.ac\\"" | "\\"sim.dc\\""' in text and "sim.mc" not in text
    with pytest.raises(ValueError):
        conv.call_grammar([])
    assert conv.system_message().count("(required)") == sum(len(a) for _, a in conv.CONTRACT)


def test_calls_against_the_contract(spark):
    calls = spark.createDataFrame([("sim.mc", '{"netlist": "x"}'), ("meas.eval", '{"signal": "a", "expression": "b"}'), ("netlist.lint", "{}"), ("pdk.get_corners", None)], "name string, arguments string")
    got = {(r.name, r.reason) for r in conv.check_calls(calls, []).collect()}
    assert got == {("sim.mc", "missing_argument"), ("netlist.lint", "unknown_tool")}


def test_supplies(spark):
    deck = "t\nV1 vdda gnd! DC 1.8 AC 1\nV2 VSUP vgnd PULSE(0 1 0)\nVb bias 0 0.7\n* V3 vdd 0 1\n"
    both = column(spark, deck, net.set_supply(F.col("text"), 1.2).alias("s"), net.set_supply(F.col("text"), 0.9, "Vb").alias("n"))
    assert both.s.changed == 2 and "V1 vdda gnd! DC 1.2 AC 1" in both.s.text and "DC 1.2 PULSE(0 1 0)" in both.s.text and "Vb bias 0 0.7" in both.s.text
    assert both.n.changed == 1 and "Vb bias 0 DC 0.9" in both.n.text


def test_parameters_are_matched_as_whole_names(spark):
    got = column(spark, "M1 d g s b nch AW=1 W = 2u", net.set_parameter(F.col("text"), "W", F.lit("9u")).alias("w"), net.set_parameter(F.col("text"), "L", F.lit("1u")).alias("l"))
    assert got.w == "M1 d g s b nch AW=1 W=9u" and got.l.endswith(" L=1u")


def test_elements_scopes_and_control_blocks(spark):
    decks = spark.createDataFrame([("d", DECK), ("e", ""), ("n", None)], "deck_id string, text string")
    got = {(r.scope, r["name"], r.letter, r.subckt) for r in net.elements(decks).collect()}
    assert got == {("", "v1", "v", None), ("", "x1", "x", "amp"), ("amp", "vx", "v", None), ("amp", "m1", "m", None)}


def test_branches_as_deep_as_they_go(spark):
    depth = 12
    subckts = spark.createDataFrame([("d", "" if i == 0 else f"s{i}", f"x{i}", f"s{i + 1}") for i in range(depth)], "deck_id string, scope string, instance string, subckt string")
    sources = spark.createDataFrame([("d", f"s{depth}", "vin", 0.7), ("d", "s8", "vin", 9.0)], "deck_id string, scope string, name string, dc double")
    path = ".".join(f"x{i}" for i in range(depth))
    branches = spark.createDataFrame([("d", f"v.{path}.vin"), ("d", "v.x0.x9.vin")], "deck_id string, branch string")
    got = {r.branch: r.dc for r in net.branch_value(branches, sources, subckts).collect()}
    assert got[f"v.{path}.vin"] == 0.7 and got["v.x0.x9.vin"] != got["v.x0.x9.vin"]


def test_corners_and_randomness(spark):
    got = column(spark, "t\nV1 vdd 0 1.8\n.temp 27\n.end\n", net.at_corner(F.col("text"), F.lit(125.0), 1.62).alias("c"), net.is_random(F.col("text")).alias("r"))
    assert got.c == "t\nV1 vdd 0 DC 1.62\n.temp 125.0\n.end" and got.r is False
    corners = spark.createDataFrame([("p", "SS", "SS", 1.6, 125.0), ("p", "tt", "TT", 1.8, 27.0)], "pdk string, corner string, section string, voltage double, temperature double")
    asks = spark.createDataFrame([(1, "p", "ss"), (2, "p", None), (3, "p", "zz"), (4, None, "tt")], "id int, pdk string, corner string")
    rows = {r.id: (r.section, r.voltage) for r in res.corner_lookup(asks, corners).collect()}
    assert rows == {1: ("SS", 1.6), 2: ("TT", None), 3: (None, None), 4: (None, None)}


def test_templates(spark):
    t = spark.createDataFrame([("a", "analog", "A"), ("b", "digital", "B")], "name string, category string, text string")
    assert net.list_templates(t).count() == 2 and net.get_template(net.list_templates(t, "digital"), "b") == "B"
    with pytest.raises(KeyError):
        net.get_template(t, "c")


def test_spec_check(spark):
    specs = spark.createDataFrame([("t", "gain", 60.0, None, None, 1.0), ("t", "ugb", 1e6, None, None, 1.0), ("u", "gain", 60.0, None, None, 1.0), ("w", "gain", 60.0, None, None, 1.0)], "task_id string, spec string, low double, high double, target double, weight double")
    got = spark.createDataFrame([("t", "gain", 61.0, None), ("u", "gain", 61.0, None), ("w", "gain", 30.0, None)], "task_id string, spec string, value double, reason string")
    rows = {r.task_id: (r.score, r.unmeasurable, r.success) for r in scoring.spec_check(got, specs).collect()}
    assert rows == {"t": (1.0, 1, False), "u": (1.0, 0, True), "w": (0.0, 0, False)}
    assert scoring.spec_check(got.limit(0), specs.limit(0)).count() == 0


def test_context_and_budget(spark):
    tasks = spark.createDataFrame([("a", "notes"), ("b", None)], "task string, notes string")
    near = spark.createDataFrame([("a", f"o{i}", i / 10, i % 2 == 0, None) for i in range(6)], "task string, other string, similarity double, success boolean, score double")
    rows = {r.task: r.context for r in retrieval.context(tasks, near, 2).collect()}
    assert rows["a"].startswith("## Process\nnotes\n\n## Past designs\n- o5: similarity 0.50, missed its specs, score 0.000\n- o4") and rows["a"].count("\n- ") == 2
    assert rows["b"] == "## Past designs\nnone in memory"
    parts = [F.lit("x" * 40), F.lit(None).cast("string"), F.lit("y" * 40), F.lit("z" * 400)]
    got = spark.range(1).select(retrieval.assemble(parts, 25).alias("two"), retrieval.assemble(parts, 1).alias("one"), retrieval.assemble(parts, 1000).alias("all")).collect()[0]
    assert got.two == "x" * 40 + "\n\n" + "y" * 40 and got.one == "x" * 40 and got.all.endswith("z")


def test_phases_errors_totals(spark):
    v = spark.createDataFrame([(1, 0, float("nan")), (1, 1, 179.0), (1, 2, 100.0), (2, 0, None)], "run int, x int, y double")
    rows = {(r.run, r.x): r.y for r in sig.normalize_phase(v).collect()}
    assert rows[(1, 1)] == -1.0 and rows[(1, 2)] == -80.0 and rows[(2, 0)] is None
    e = spark.range(1).select(conv.first_errors(F.array(*[F.lit(str(i)) for i in range(30)])).alias("e")).collect()[0].e
    assert len(e.first) == 20 and e.total == 30
    none = spark.createDataFrame([], "tokens long, seconds double")
    assert evaluation.agent_totals(none).collect()[0].asDict() == {"tokens": 0, "seconds": 0.0}


def test_sizing_fails_without_values(spark):
    c = spark.createDataFrame([("t", 1, "M1 d g s b n W={w}", {"w": "10u"}), ("t", 2, "M1 d g s b n W={w}", {"v": "1u"})], "task string, candidate int, template string, values map<string,string>")
    rows = {r.candidate: r.score for r in res.sizing(c, F.lit(20.0)).collect()}
    assert rows == {1: 1.0, 2: -1.0}
    assert res.best_sizing(res.sizing(c, F.lit(20.0))).collect()[0].candidate == 1


def test_filler_mix_is_exact_without_one_sorted_partition(spark):
    a, b = spark.range(90).withColumnRenamed("id", "k"), spark.range(1000).withColumnRenamed("id", "k")
    got = corpus.mix(a, b, 0.1, "k")
    assert got.filter("origin = 'filler'").count() == 10 and got.count() == 100
    want = [r.k for r in b.orderBy(F.md5(F.col("k").cast("string"))).limit(10).collect()]
    assert {r.k for r in got.filter("origin = 'filler'").collect()} == set(want)


def test_hot_keys_are_not_shuffled(spark, monkeypatch):
    """One key with a third of the rows: the same result, its rows joined by broadcast."""
    monkeypatch.setattr(runtime, "HOT_ROWS", 50)
    left = spark.range(600).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert runtime.join_skewed(left, right, "k", "n", 600, how_many=10).select("id").distinct().count() == 600


def test_tables_are_released(spark):
    df = runtime.cut(spark.range(5))
    path = next(p for a, p in runtime._WRITTEN[::-1])
    assert df.count() == 5 and runtime.cut(spark.range(0)).count() == 0
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert fs.exists(where)
    runtime.release(spark)
    assert not fs.exists(where)


def test_entry_without_the_optional_queries():
    """A package the optional queries need is missing: the rest is still there."""
    root = str(Path(__file__).resolve().parents[1])
    code = "import sys, warnings; sys.modules['xxhash'] = None; warnings.simplefilter('ignore'); import __spark_entry__ as e; q = e.queries(); print(len(q), 'p4_found' in q, any(n.startswith('p1') for n in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root).stdout.split()
    assert int(out[0]) > 100 and out[1:] == ["True", "False", "True"]


def test_search_finds_the_optimum_and_skips_failures(spark):
    from circuitlake.operators import search

    bounds = spark.createDataFrame([("t", "a", 0.0, 1.0), ("t", "b", -2.0, 2.0)], "task string, name string, low double, high double")
    goal = {"a": 0.3, "b": -1.1}

    def evaluate(rows):
        gap = F.when(F.col("name") == "a", F.col("value") - goal["a"]).otherwise(F.col("value") - goal["b"])
        total = rows.groupBy("task", "candidate").agg(F.sum(-gap * gap).alias("s"), F.max("value").alias("m"))
        return rows.join(total.select("task", "candidate", F.when(F.col("m") < 1.5, F.col("s")).alias("score")), ["task", "candidate"])

    got = {r["name"]: r.value for r in search.Shrinking().optimize(bounds, evaluate, 6).collect()}
    assert all(abs(got[n] - v) < 0.06 for n, v in goal.items())
    with pytest.raises(TypeError):
        search.Optimizer()


def test_quick_metrics(spark):
    v = spark.createDataFrame([(1, 1.0, 10.0), (1, 2.0, 8.0), (1, 3.0, 6.5), (1, 4.0, 7.0), (2, 1.0, 5.0)], "run long, x double, y double")
    rows = {r.run: r for r in sig.quick_metrics(sig.with_next(v, 8.0)).collect()}
    assert (rows[1].first, rows[1].bandwidth, rows[1].swing, rows[1].steepest) == (10.0, 3.0, 3.5, -2.0)
    assert rows[2].bandwidth is None and rows[2].steepest is None
