"""Unit parsing and conversion."""

import pytest

from circuitlake.functions import unitparse as up
from circuitlake.operators import units

MEAS = "meas_id long, source string, metric string, value double, unit string, metadata map<string,string>, extra string, status string"
METRIC = "metric string, dimension string, common_unit string"
SOURCE = "source string, kind string, unit_note string"
METRICS = [("idd", "current", "nA"), ("vout", "voltage", "uV"), ("dc_gain", "gain", "mdB"), ("tj", "temperature", "mC"), ("rout", "resistance", "mohm"), ("power", "power", "nW"), ("cload", "capacitance", "fF"), ("ugb", "frequency", "Hz"), ("slew_rate", "slew", "V/s")]


@pytest.mark.parametrize(
    "text, dimension, power",
    [
        ("MV", "voltage", -3), ("mohm", "resistance", -3), ("Mohm", "resistance", 6), ("MΩ", "resistance", 6), ("kiloohms", "resistance", 3),
        ("mhz", "frequency", 6), ("KHZ", "frequency", 3), ("kilohertzs", "frequency", 3), ("MA", "current", -3), ("µA", "current", -6), ("μA", "current", -6),
        ("NV", "voltage", -9), ("nsec", "time", -9), ("nanoseconds", "time", -9), ("V per us", "slew", 6), ("mV/us", "slew", 3), ("V/nsec", "slew", 9),
        ("nV Hz^-0.5", "noise", -9), ("µV/√Hz", "noise", -6), ("pV/rtHz", "noise", -12), ("dB(mW)", "power", 0), ("V/V", "gain", 0), ("mdB", "gain", -3),
        (" pF ", "capacitance", -12), ("degF", "temperature", 0), ("mC", "temperature", -3), ("°", "angle", 0),
    ],
)
def test_readings(text, dimension, power):
    r = up.parse(text, dimension)
    assert r is not None and r.dimension == dimension and r.power == power


def test_prior_decides_between_farad_and_fahrenheit():
    assert dict(up.parse("F", "capacitance").factors) == {"F": 1.0}
    assert dict(up.parse("F", "temperature").factors) == {"degF": 1.0}
    assert up.parse("volts", "current").dimension == "voltage"
    assert up.parse("bananas", "current") is None and up.parse(None) is None and up.parse("x" * 10_000) is None


@pytest.mark.parametrize(
    "text, metric, number, unit",
    [
        ("idd = 1,5 uA", "idd", 1.5, "uA"), ("result IDD 2.5e+02 nA ok", "idd", 250.0, "nA"), ("idd=-3 pA (step 651.787 us)", "idd", -3.0, "pA"),
        ("VDD 0.2 V -> vout: 47.2 mV", "vout", 47.2, "mV"), ("vout(typ) read 0.89 V at fs, step 453 us", "vout", 0.89, "V"),
        ("with chuck 53C, tone 670 kHz: power -0.18 dB(mW)", "power", -0.18, "dB(mW)"), ("unit=ns", "ugb", None, "ns"), ("input_noise_density = 1.5 uV/sqrt(Hz)", "input_noise_density", 1.5, "uV/sqrt(Hz)"), ("power=2 dB(mW) (VDD 3 V)", "power", 2.0, "dB(mW)"), ("scale: uA at ff", "idd", None, "uA"),
        ("[kHz] VDD 386 mV", "ugb", None, "kHz"), ("load 725 nA; reading is pF", "cload", None, "pF"), ("ugb(worst) / MHz, chuck 19C", "ugb", None, "MHz"),
        ("checked by hand", "idd", None, None), ("idd ok", "idd", None, None), ("", "idd", None, None),
    ],
)
def test_texts(text, metric, number, unit):
    assert units.read_text(text, metric) == (number, unit)


def test_notes():
    note = "Unless a row says otherwise currents are in uA, gains are in V/V, slew rates are in V/ns."
    assert units.read_note(note, "current") == "uA" and units.read_note(note, "slew") == "V/ns" and units.read_note(note, "power") is None
    assert units.read_note("Columns without a unit: slew rates [V/ns]; gains [dB]. Exported by the bench PC.", "gain") == "dB"
    assert units.read_note("Capacitances default to nF. Powers default to uW.", "power") == "uW"
    assert units.read_note(None, "power") is None


def run(spark, rows, notes=()):
    m = spark.createDataFrame([(*r, "x", "y") for r in rows], MEAS)
    return {r["meas_id"]: r for r in units.convert(m, spark.createDataFrame(METRICS, METRIC), spark.createDataFrame(list(notes), SOURCE)).collect()}


def test_conversion_cases(spark):
    rows = [
        (1, "a", "idd", 1.5, "uA", None), (2, "a", "idd", 7.0, "nA", None), (3, "a", "idd", None, None, {"text": "idd = 2,5 mA"}), (4, "b", "idd", 2.0, "-", None),
        (5, "c", "idd", 2.0, " ", None), (6, "a", "idd", 2.0, "V", None), (7, "a", "idd", float("nan"), "uA", {"text": "timeout"}), (8, "a", None, 1.0, "uA", None),
        (9, "a", "dc_gain", 10.0, "V/V", None), (10, "a", "dc_gain", -1.0, "V/V", None), (11, "a", "tj", 300.0, "K", None), (12, "a", "tj", 32.0, "F", None),
        (13, "a", "power", 0.0, "dBm", None), (14, None, "rout", 1.0, "Mohm", {}), (15, "a", "idd", 1e300, "A", None), (16, "a", "idd", 3.0, None, {"text": "unit=mV"}),
        (17, "b", "nosuch", 1.0, None, None),
    ]
    got = run(spark, rows, [("b", "lab", "Currents default to uA."), ("b", "lab", None)])
    value = {k: r["common_value"] for k, r in got.items()}
    assert value[1] == 1500 and value[2] == 7 and value[3] == 2_500_000 and value[4] == 2000
    assert value[9] == 20000 and value[11] == 26850 and value[12] == 0 and value[13] == 1_000_000 and value[14] == 10**9
    status = {k: r["status"] for k, r in got.items()}
    assert status[2] == "common" and status[5] == "no_unit" and status[6] == "other_dimension" and status[7] == "no_number"
    assert status[8] == status[17] == "unknown_metric" and status[10] == status[15] == "out_of_range" and status[16] == "other_dimension"


def test_repeats_and_empty_tables(spark):
    rows = [(1, "a", "idd", 1.5, "uA", None, "x", "y")] * 3 + [(None, "a", "idd", 1.5, "uA", None, "x", "y")]
    metrics, notes = spark.createDataFrame(METRICS, METRIC), spark.createDataFrame([], SOURCE)
    assert [tuple(r) for r in units.converted(spark.createDataFrame(rows, MEAS), metrics, notes).collect()] == [(1, 1500)]
    assert units.converted(spark.createDataFrame([], MEAS), metrics, notes).count() == 0
