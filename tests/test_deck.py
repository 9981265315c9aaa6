"""Canonical decks and netlist perturbations."""

import hypothesis.strategies as st
import pytest
from hypothesis import given, settings

from circuitlake.functions import deck
from circuitlake.operators import netlists as net

A = "* a title\nVDD vdd 0 dc 2.5\nM1 d g 0 0 nch W=1.5u L=200n M=2\nR1 a b 10k\n.tran 1n\n.end\n"
B = "title b\nr1 A B 10000 ; keep\n* comment\nm1 D G 0 0 NCH\n+ L=0.2u  M=2.0 w=1500n $ note\nvdd VDD gnd 2500m\n.TRAN 1e-9\n.end\nignored 1 2"


def test_same_circuit_however_written():
    assert deck.canonical(A) == deck.canonical(B)
    assert deck.identity(A) == deck.identity(B)


def test_differences_count():
    for old, new in (("1.5u", "1.6u"), ("10k", "10meg"), ("nch", "pch"), ("a b", "b a"), ("1n", "2n"), ("M=2", "")):
        assert deck.identity(A) != deck.identity(A.replace(old, new)), (old, new)


def test_files_and_blanks():
    assert deck.identity("/tmp/x/CS_AMP.cir") == deck.identity("D:\\runs\\cs_amp.CIR\n")
    assert deck.identity("a/one.cir") != deck.identity("a/two.cir")
    assert deck.identity(None) is None and deck.identity(" \n\t") is None
    assert deck.identity("x" * 100_000).startswith("file:")


def test_subcircuits_are_scopes():
    one = "t\n.subckt s a b\nR1 a b 1k\n.ends\nR1 a b 2k\n"
    two = "t\n.subckt s a b\nR1 a b 2k\n.ends\nR1 a b 1k\n"
    assert deck.identity(one) != deck.identity(two)


@settings(max_examples=60, deadline=None)
@given(st.permutations(A.splitlines()[1:5]), st.booleans())
def test_order_and_case_mean_nothing(cards, upper):
    text = "other title\n" + "\n".join(cards) + "\n.end\n"
    assert deck.canonical(text.upper() if upper else text) == deck.canonical(A)


@settings(max_examples=80, deadline=None)
@given(st.sampled_from([*net.PERTURBATIONS, "swap_models"]), st.integers(0, 10_000))
def test_perturbations_are_seeded_and_change_one_place(kind, seed):
    text = A + "I1 a b 10u\nC1 a 0 1p\nM2 d g 0 0 pch W=2u L=1u m=4"
    got, changed = net.perturb(text, kind, seed)
    assert (got, changed) == net.perturb(text, kind, seed)
    different = sum(a.split() != b.split() for a, b in zip(text.split("\n"), got.split("\n"), strict=True))
    assert different <= (2 if kind == "swap_models" else 1)
    assert changed or got == text
    assert net.perturb("no elements", kind, seed) == ("no elements", False)


def test_format_and_parse_numbers(spark):
    for value, text in ((1e-5, "10u"), (0.0, "0"), (2.5e6, "2.5x"), (1500.0, "1.5k"), (-3e-12, "-3p")):
        assert net.format_number(value) == text
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("10u",), ("2meg",), ("1.8V",), ("abc",), (None,), ("5x",)], "t string")
    got = [(r.a, r.b) for r in rows.select(net.strict_number(F.col("t")).alias("a"), net.loose_number(F.col("t")).alias("b")).collect()]
    assert got[0] == pytest.approx((1e-5, 1e-5)) and got[1][0] == 2e6 and got[2] == (1.8, 1.8) and got[3][0] == 0.0 and got[3][1] != got[3][1] and got[4][1] is None and got[5] == (5e6, 5.0)


def test_branch_values_and_supply(spark):
    decks = spark.createDataFrame([("d", "t\nV1 vdd 0 1.8\nVSENSE a b 0\nX1 a b sub\n.subckt sub p q\nV2 p q DC 0.5\n.ends\nV3 n 0 {x}\n")], "deck_id string, text string")
    s = net.sources(decks)
    assert {(r.scope, r.name): r.dc for r in s.collect() if r.dc == r.dc} == {("", "v1"): 1.8, ("", "vsense"): 0.0, ("sub", "v2"): 0.5}
    subs = spark.createDataFrame([("d", "", "x1", "sub")], "deck_id string, scope string, instance string, subckt string")
    b = spark.createDataFrame([("d", "v1"), ("d", "v.x1.v2"), ("d", "v.x9.v2")], "deck_id string, branch string")
    got = {r.branch: r.dc for r in net.branch_value(b, s, subs).collect()}
    assert got["v1"] == 1.8 and got["v.x1.v2"] == 0.5 and got["v.x9.v2"] != got["v.x9.v2"]
    amps = spark.createDataFrame([("d", "v1", -0.25), ("d", "vsense", 9.0)], "deck_id string, name string, amps double")
    row = net.supply_current(amps, s).collect()[0]
    assert row.total == 0.25 and row.used == 1


def test_noise_kinds_and_pins(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("t\n.noise v(out) Iin dec 10 1 1k\nX1 a b nch_mac w=1\nX2 a b other",)], "t string").select(net.noise_kinds(F.col("t")).alias("k"), net.pin_parameters(F.col("t"), ".*_mac$", {"sigma": "0"}).alias("p")).collect()[0]
    assert (row.k.input, row.k.output) == ("i", "v")
    assert "nch_mac w=1 sigma=0" in row.p and "X2 a b other" in row.p
