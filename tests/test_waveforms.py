"""Analytic waveforms with known answers."""

import numpy as np
import pytest

from circuitlake.operators import waveforms as wf


def single_pole(f, gain=60.0, fp=1e3):
    h = 10 ** (gain / 20) / (1 + 1j * f / fp)
    return 20 * np.log10(np.abs(h)), np.degrees(np.angle(h))


def test_single_pole_edges_and_margin():
    f = np.logspace(0, 8, 801)
    g, p = single_pole(f)
    m, n = wf.ac_metrics(f, g, p)
    assert m["dc_gain_db"] == pytest.approx(60, abs=1e-4)
    assert m["bandwidth_3db"] == pytest.approx(1e3, rel=1e-3)
    assert m["ugb"] == pytest.approx(1e6, rel=1e-3)
    assert m["phase_margin"] == pytest.approx(90, abs=0.2)
    assert m["rolloff"] == pytest.approx(-20, abs=0.01)
    assert "gain_margin" not in m and n["gain_margin"] == "infinite"


def test_inversion_is_removed():
    f = np.logspace(0, 8, 401)
    g, p = single_pole(f)
    a, _ = wf.ac_metrics(f, g, p)
    b, _ = wf.ac_metrics(f, g, p + 180)
    assert b["inversions"] == 1 and b["phase_margin"] == pytest.approx(a["phase_margin"])


def test_phase_margin_does_not_depend_on_sweep_start():
    got = []
    for start in (-1, 1, 2):
        f = np.logspace(start, 8, 1001)
        h = 1e3 / ((1 + 1j * f / 1e4) * (1 + 1j * f / 1e6))
        got.append(wf.ac_metrics(f, 20 * np.log10(np.abs(h)), np.degrees(np.angle(h)))[0]["phase_margin"])
    assert max(got) - min(got) < 0.1


def test_three_poles_have_gain_margin():
    f = np.logspace(0, 8, 2001)
    h = 4 / (1 + 1j * f / 1e4) ** 3
    m, _ = wf.ac_metrics(f, 20 * np.log10(np.abs(h)), np.degrees(np.angle(h)))
    assert m["gain_margin"] == pytest.approx(20 * np.log10(8 / 4), abs=0.01)
    assert m["f_180"] == pytest.approx(1e4 * np.sqrt(3), rel=1e-3)


def test_coupled_response_has_no_dc_gain():
    f = np.logspace(1, 7, 601)
    h = (1j * f / 100) / (1 + 1j * f / 100) / (1 + 1j * f / 1e6) * 10
    m, n = wf.ac_metrics(f, 20 * np.log10(np.abs(h)), np.degrees(np.angle(h)))
    assert "dc_gain_db" not in m and n["dc_gain_db"] == "slopes_at_start"
    assert m["passband_gain_db"] == pytest.approx(20, abs=0.05)
    assert n["bandwidth_3db"] == "band_pass" and m["f_3db_lo"] == pytest.approx(100, rel=0.02)


def test_sweep_above_the_pole_is_refused():
    f = np.logspace(5, 7, 201)
    g, _ = single_pole(f)
    m, n = wf.ac_metrics(f, g)
    assert "bandwidth_3db" not in m and n["bandwidth_3db"] == "passband_outside_sweep"


def test_nan_phase_and_empty_response():
    f = np.logspace(0, 6, 101)
    g, p = single_pole(f)
    p[0] = np.nan
    m, _ = wf.ac_metrics(f, g, p)
    assert m["phase_margin"] == pytest.approx(90, abs=0.5) if "ugb" in m else True
    assert wf.ac_metrics(np.array([]), np.array([]))[1] == {"all": "no_finite_sample"}


def test_rc_step():
    t = np.linspace(0, 20, 20001)
    y = np.where(t < 1, 0, 1 - np.exp(-(t - 1)))
    m, n = wf.tran_metrics(t, y, (t >= 1).astype(float))
    assert m["rise_time"] == pytest.approx(np.log(9), rel=1e-3)
    assert m["overshoot_pct"] == 0.0
    assert m["settling_time"] == pytest.approx(1 + np.log(50), rel=1e-2)
    assert m["prop_delay"] == pytest.approx(np.log(2), rel=1e-2)
    assert m["slew_rate"] == pytest.approx(0.8 / np.log(9), rel=1e-3)


def test_ringing_overshoot():
    z, t = 0.5, np.linspace(0, 40, 40001)
    wd = np.sqrt(1 - z * z)
    y = 1 - np.exp(-z * t) * (np.cos(wd * t) + z / wd * np.sin(wd * t))
    m, _ = wf.tran_metrics(t, y)
    assert m["overshoot_pct"] == pytest.approx(100 * np.exp(-np.pi * z / wd), rel=1e-3)


def test_record_that_still_moves_is_refused():
    t = np.linspace(0, 1e-3, 1001)
    m, n = wf.tran_metrics(t, 1 - np.exp(-t))
    assert n["all"] == "unsettled" and "rise_time" not in m


def test_pulse_uses_its_first_edge():
    t = np.linspace(0, 30, 30001)
    up = 1 - np.exp(-np.clip(t - 1, 0, None))
    y = np.where(t < 15, up, up[15000] * np.exp(-np.clip(t - 15, 0, None)))
    m, n = wf.tran_metrics(t, y)
    assert n["levels"] == "returns_to_start"
    assert m["rise_time"] == pytest.approx(np.log(9), rel=1e-2)
    assert m["edge_count"] == 2


def test_flat_band_refuses_a_resonance():
    f = np.logspace(3, 6, 61)
    g = 35 + 7 * np.exp(-((np.log10(f) - 5.95) ** 2) / 0.002)
    _, value = wf.flat_band(f, g)
    assert value == pytest.approx(35, abs=0.1)


def test_row_order_and_density_do_not_matter(spark):
    import pandas as pd

    rows = []
    for run, n in ((1, 401), (2, 1601)):
        f = np.logspace(0, 8, n)
        g, p = single_pole(f)
        rows += [(run, *x) for x in zip(f.tolist(), g.tolist(), p.tolist(), strict=True)]
    df = pd.DataFrame(rows, columns=["run", "f", "gain_db", "phase_deg"]).sample(frac=1, random_state=0)
    got = {r["run"]: r for r in wf.ac(spark.createDataFrame(df)).collect()}
    assert got[1]["ugb"] == pytest.approx(got[2]["ugb"], rel=1e-3)
    assert wf.tran(spark.createDataFrame([], "run long, t double, y double, drive double")).count() == 0
