"""Metrics of whole waveforms and frequency responses that no window can express.

One Arrow-batched kernel per run computes all metrics of a signal at once. A run is one
simulated record, which is bounded by its simulation; runs are independent groups. What
the data does not define is null with a reason code in `notes`, never a number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tolerances that define the metrics.
DB3 = 10.0 * np.log10(2.0)
SLOPE_SPAN = 0.1  # decades over which a slope is measured
SLOPE_TOLERANCE = 0.25  # dB per decade that count as flat
FLAT_SAMPLES = 3
INVERSION_TOLERANCE = 60.0  # degrees
LEAD_TOLERANCE = 0.01  # degrees
LEAD_RATIO = 2.0
RETURN_SHARE = 0.4  # of the excursion; below it a record returned to its start
RETURN_RATE = 0.1
MONOTONE_SHARE = 1e-6
SETTLE_RATE = 0.02
WINDOW = 0.02  # share of a record averaged at its ends
DRIFT = 0.002  # share of the excursion


def _log_x(f: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log10(np.where(f > 0, f, np.nan))


def _meet(f, v, i, level):
    """Frequency where segment i meets the level, in log10(f) where possible."""
    share = (level - v[i]) / (v[i + 1] - v[i])
    if f[i] > 0 and f[i + 1] > 0:
        return float(f[i] * (f[i + 1] / f[i]) ** share)
    return float(f[i] + share * (f[i + 1] - f[i]))


def crossing_indices(v: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """(segments that reach the level falling, rising); NaN and flat segments do neither."""
    a, b = v[:-1], v[1:]
    with np.errstate(invalid="ignore"):
        return np.flatnonzero((a >= level) & (level >= b) & (a > b)), np.flatnonzero((a <= level) & (level <= b) & (a < b))


def value_at(f: np.ndarray, v: np.ndarray, target: float) -> float | None:
    """Value at a frequency inside the sweep, linear in log10(f); None outside."""
    hit = np.flatnonzero(f == target)
    if len(hit):
        return float(v[hit[0]])
    i = int(np.searchsorted(f, target)) - 1
    if i < 0 or i + 1 >= len(f):
        return None
    if f[i] > 0:
        share = np.log(target / f[i]) / np.log(f[i + 1] / f[i])
    else:
        share = (target - f[i]) / (f[i + 1] - f[i])
    return float(v[i] + share * (v[i + 1] - v[i]))


def slope_from(f: np.ndarray, g: np.ndarray, i: int) -> float | None:
    """dB per decade from sample i to the first finite one at least SLOPE_SPAN decades up, else the last finite one."""
    x = _log_x(f)
    if not np.isfinite(x[i]) or not np.isfinite(g[i]):
        return None
    later = np.flatnonzero(np.isfinite(x) & np.isfinite(g))
    later = later[later > i]
    if not len(later):
        return None
    far = later[x[later] >= x[i] + SLOPE_SPAN - 1e-12]
    j = int(far[0]) if len(far) else int(later[-1])
    return float((g[j] - g[i]) / (x[j] - x[i])) if x[j] > x[i] else None


def flat_band(f: np.ndarray, g: np.ndarray) -> tuple[int | None, float | None]:
    """(sample, value) of the highest window that spans SLOPE_SPAN decades, holds FLAT_SAMPLES
    finite samples and varies by at most SLOPE_TOLERANCE per decade of its span."""
    ok = np.isfinite(g) & (f > 0)
    at = np.flatnonzero(ok)
    x, y = _log_x(f[at]), g[at]
    best: tuple[int | None, float | None] = (None, None)
    for i in range(len(at)):
        if best[1] is not None and y[i] <= best[1]:
            continue
        j = max(int(np.searchsorted(x, x[i] + SLOPE_SPAN - 1e-12)), i + FLAT_SAMPLES - 1)
        if j >= len(at):
            break
        part = y[i : j + 1]
        if part.max() - part.min() <= SLOPE_TOLERANCE * (x[j] - x[i]):
            best = (int(at[i]), float(y[i]))
    return best


def unwrap(p: np.ndarray) -> np.ndarray:
    """Continuous phase; NaN passes through and steps of exactly 180 degrees stay."""
    out = p.astype(float).copy()
    ok = np.flatnonzero(np.isfinite(out))
    d = np.diff(out[ok])
    d = np.where(d > 180, d - 360 * np.ceil((d - 180) / 360), np.where(d < -180, d - 360 * np.floor((d + 180) / 360), d))
    if len(ok):
        out[ok] = out[ok[0]] + np.concatenate([[0.0], np.cumsum(d)])
    return out


def phase_lead(f: np.ndarray, g: np.ndarray, p: np.ndarray) -> float | None:
    """Degrees of 1/f lead at the lowest frequency, parted from lag that grows with f by a second sample."""

    def rest(i):
        s = slope_from(f, g, i)
        return None if s is None or not np.isfinite(p[i]) else p[i] - 4.5 * s

    first = rest(0)
    if first is None or f[0] <= 0:
        return None
    up = np.flatnonzero(f >= LEAD_RATIO * f[0])
    second = rest(int(up[0])) if len(up) else None
    if second is None:
        return first
    r = f[up[0]] / f[0]
    return float(r * (first * r - second) / (r * r - 1))


AC_METRICS = (
    "low_freq_gain_db", "dc_gain_db", "low_slope", "peak_gain_db", "f_peak", "passband_gain_db", "bandwidth_3db", "f_3db_lo", "f_3db_hi",
    "ugb", "phase_margin", "gain_margin", "f_180", "inversions", "rolloff",
)


def ac_metrics(f: np.ndarray, g: np.ndarray, p: np.ndarray | None = None) -> tuple[dict[str, float], dict[str, str]]:
    """(metrics, notes) of a frequency response: gain in dB, phase in degrees or None."""
    out: dict[str, float] = {}
    notes: dict[str, str] = {}
    f, g = np.asarray(f, float), np.asarray(g, float)
    if not len(f) or not np.isfinite(g).any():
        return out, {"all": "no_finite_sample"}
    out["low_freq_gain_db"] = g[0]
    top = int(np.nanargmax(np.where(np.isfinite(g), g, -np.inf)))
    peak = float(g[top])
    out["peak_gain_db"], out["f_peak"] = peak, f[top]
    slope = slope_from(f, g, 0) if f[0] > 0 else slope_from(f, g, min(1, len(f) - 1))
    if slope is not None:
        out["low_slope"] = slope
    at_zero = f[0] == 0 and np.isfinite(g[0])

    phase = None
    if p is not None and np.isfinite(p).any():
        phase = unwrap(np.asarray(p, float))
        ref = int(np.flatnonzero(np.isfinite(phase))[0])
        here = 0.0 if at_zero else (lambda s: None if s is None else 4.5 * s)(slope_from(f, g, ref))
        turns = 0
        if here is not None:
            turns = round((phase[ref] - here) / 180.0)
            if abs(phase[ref] - here - 180.0 * turns) > INVERSION_TOLERANCE:
                turns = 2 * round((phase[ref] - here) / 360.0)
        else:
            turns = 2 * round(phase[ref] / 360.0)
            notes["phase"] = "no_reference"
        phase = phase - 180.0 * turns
        out["inversions"] = float(turns)

    # does the sweep show the gain at DC?
    if f[0] <= 0:
        reaches = bool(np.isfinite(g[0]))
        if not reaches:
            notes["dc_gain_db"] = "zero_gain_at_dc"
    elif slope is None:
        reaches = False
        notes["dc_gain_db"] = "no_low_span"
    elif abs(slope) > SLOPE_TOLERANCE:
        reaches = False
        notes["dc_gain_db"] = "slopes_at_start"
    else:
        lead = phase_lead(f, g, phase) if phase is not None else None
        reaches = lead is None or lead <= LEAD_TOLERANCE
        if not reaches:
            notes["dc_gain_db"] = "phase_leads_at_start"
        elif phase is None:
            notes["dc_gain_db"] = "phase_unchecked"
    ref_gain: float | None = peak
    outside = False
    if reaches:
        out["dc_gain_db"] = ref_gain = float(g[0])
        out["passband_gain_db"] = ref_gain
    else:
        _, flat = flat_band(f, g)
        if flat is not None:
            out["passband_gain_db"] = ref_gain = flat
            if peak - flat > SLOPE_TOLERANCE:
                notes["passband_gain_db"] = "peaks_above_passband"
        else:
            outside = top in (0, len(f) - 1)
            notes["passband_gain_db"] = "passband_outside_sweep" if outside else "no_flat_region"
    # -3 dB edges around the peak
    if outside:
        notes["bandwidth_3db"] = "passband_outside_sweep"
    else:
        falling, rising = crossing_indices(g, ref_gain - DB3)
        after = falling[falling >= top]
        below = rising[rising < top]
        if len(below):
            out["f_3db_lo"] = _meet(f, g, below[-1], ref_gain - DB3)
        if len(after):
            hi = out["f_3db_hi"] = _meet(f, g, after[0], ref_gain - DB3)
            if any(_meet(f, g, i, ref_gain - DB3) > hi for i in rising):
                notes["bandwidth_3db"] = "several_bands"
            else:
                out["bandwidth_3db"] = hi
                if "f_3db_lo" in out:
                    notes["bandwidth_3db"] = "band_pass"
        else:
            notes["bandwidth_3db"] = "edge_not_reached"
    # loop closure
    finite = g[np.isfinite(g)]
    if peak <= 0:
        notes["ugb"] = "never_above_unity"
    elif finite.max() - finite.min() <= 1e-6:
        notes["ugb"] = "flat"
    else:
        above = np.flatnonzero(np.isfinite(g) & (g > 0))
        later = np.flatnonzero(np.isfinite(g))
        later = later[later > above[-1]]
        if len(later):
            pair_f, pair_g = f[[above[-1], later[0]]], g[[above[-1], later[0]]]
            out["ugb"] = _meet(pair_f, pair_g, 0, 0.0)
            if len(crossing_indices(g, 0.0)[0]) > 1:
                notes["ugb"] = "several_crossings"
        else:
            notes["ugb"] = "unity_not_reached"
    if f[0] > 0 and f[-1] / 10 >= f[0]:
        low = value_at(f, g, f[-1] / 10)
        if low is not None and np.isfinite(low) and np.isfinite(g[-1]):
            out["rolloff"] = float(g[-1] - low)
    if phase is None:
        return out, notes
    if "ugb" in out:
        at = value_at(f, phase, out["ugb"])
        if at is not None and np.isfinite(at):
            out["phase_margin"] = 180.0 + at
        else:
            notes["phase_margin"] = "no_phase_at_unity"
    else:
        notes["phase_margin"] = "no_unity_gain"
    worst = [(value_at(f, g, fc), fc) for fc in (_meet(f, phase, i, -180.0) for i in crossing_indices(phase, -180.0)[0])]
    worst = [(v, fc) for v, fc in worst if v is not None and np.isfinite(v)]
    first = phase[np.isfinite(phase)][0]
    low_phase = np.flatnonzero(np.isfinite(phase) & np.isfinite(g) & (phase <= -180.0 + 1e-9))
    if worst:
        gain, at = max(worst)
        out["gain_margin"], out["f_180"] = -gain, at
        if len(worst) > 1:
            notes["gain_margin"] = "several_crossings"
    elif first < -180.0 - 1e-9:
        notes["gain_margin"] = "crossing_below_sweep"
    elif len(low_phase):
        i = low_phase[int(np.argmax(g[low_phase]))]
        out["gain_margin"], out["f_180"] = -float(g[i]), float(f[i])
        notes["gain_margin"] = "phase_rests_at_180"
    else:
        notes["gain_margin"] = "infinite"
    return out, notes


# --- transients


def window_drift(v: np.ndarray) -> float | None:
    return None if len(v) < 2 else float(abs(v[len(v) // 2 :].mean() - v[: len(v) // 2].mean()))


def settled_levels(y: np.ndarray) -> tuple[float, float]:
    """Mean of the first and last WINDOW of a record; the leading window is halved while it drifts."""
    k = max(1, int(len(y) * WINDOW))
    end = float(y[-k:].mean())
    finite = y[np.isfinite(y)]
    swing = float(finite.max() - finite.min()) if len(finite) else 0.0
    while k > 1:
        drift, scale = window_drift(y[:k]), max(swing, abs(end - y[0]))
        if drift is None or scale <= 0 or drift <= DRIFT * scale:
            break
        k //= 2
    return float(y[:k].mean()), end


def settle_ratio(t: np.ndarray, y: np.ndarray, end: int, k: int) -> float | None:
    """Rate of change over the last k samples up to `end`, over the largest such rate before.

    Rates compare the means of a window's halves at the halves' mean times; running sums
    make all windows one subtraction. None if two windows do not fit.
    """
    if k < 2 or end + 1 < 2 * k:
        return None
    h = k // 2
    sy, st = (np.concatenate([[0.0], np.cumsum(np.where(np.isfinite(v), v, 0.0))]) for v in (y, t))
    s = np.arange(end - k + 2)
    dy = (sy[s + k] - sy[s + h]) / (k - h) - (sy[s + h] - sy[s]) / h
    dt = (st[s + k] - st[s + h]) / (k - h) - (st[s + h] - st[s]) / h
    rate = np.abs(dy[dt > 0] / dt[dt > 0])
    if not len(rate) or dt[-1] <= 0 or rate.max() <= 0:
        return None
    return float(rate[-1] / rate.max())


def monotone(y: np.ndarray, direction: float, swing: float) -> bool:
    v = y[np.isfinite(y)]
    return bool(direction == 0 or (np.sign(direction) * np.diff(v) >= -MONOTONE_SHARE * swing).all())


def levels(t: np.ndarray, y: np.ndarray) -> dict:
    """kind (step, pulse, unsettled, flat), base and top level, last sample of the region, monotone, note.

    A record that comes back to its start is a pulse: its top is the plateau of the first
    excursion and the region ends where the return edge starts. A top that is still moving
    at the end of the region is no level.
    """
    finite = y[np.isfinite(y)]
    if not len(finite):
        return {"kind": "flat", "y0": None, "y1": None, "end": len(y) - 1, "monotone": True, "note": "no_finite_sample"}
    swing = float(finite.max() - finite.min())
    y0, tail = settled_levels(y)
    out = {"kind": "flat", "y0": y0, "y1": y0, "end": len(y) - 1, "monotone": True, "note": "constant"}
    if swing <= 0:
        return out
    if abs(tail - y0) >= RETURN_SHARE * swing:
        k = max(1, int(len(y) * WINDOW))
        ratio, drift = settle_ratio(t, y, len(y) - 1, k), window_drift(y[-k:])
        moving = ratio is not None and ratio > SETTLE_RATE or drift is not None and drift > DRIFT * swing
        return out | {"kind": "unsettled" if moving else "step", "y1": tail, "monotone": monotone(y, tail - y0, swing), "note": "still_moving" if moving else ""}
    away = np.where(np.isfinite(y), np.abs(y - y0), 0.0)
    if away.max() <= 0:
        return out
    tops = np.sort(away[away >= 0.5 * away.max()])
    half = 0.5 * tops[len(tops) // 2]
    start = int(np.flatnonzero(away >= half)[0])
    sign = 1.0 if y[start] > y0 else -1.0
    back = np.flatnonzero(np.isfinite(y[start + 1 :]) & (sign * (y[start + 1 :] - y0) < half))
    end = len(y) - 1
    if len(back):
        ret = start + 1 + int(back[0])
        end = ret - 1
        edge = abs(y[ret] - y[end]) / (t[ret] - t[end]) if t[ret] > t[end] else 0.0
        while end > start and sign * (y[end] - y[end - 1]) < 0 and t[end] > t[end - 1] and abs(y[end] - y[end - 1]) / (t[end] - t[end - 1]) >= RETURN_RATE * edge > 0:
            end -= 1
    m = max(1, int((end - start + 1) * WINDOW))
    top = float(y[end - m + 1 : end + 1].mean())
    ratio = settle_ratio(t, y, end, max(2, int((end - start + 1) * WINDOW)))
    moving = ratio is not None and ratio > SETTLE_RATE
    return out | {
        "kind": "unsettled" if moving else "pulse", "y1": top, "end": end,
        "monotone": monotone(y[: end + 1], top - y0, swing), "note": "top_never_formed" if moving else "returns_to_start",
    }


def crossing_time(t: np.ndarray, y: np.ndarray, level: float, rising: bool, start: int = 0, end: int | None = None) -> float | None:
    stop = len(y) if end is None else end + 1
    fall, rise = crossing_indices(y[:stop], level)
    for i in rise if rising else fall:
        if i >= start and t[i + 1] > t[i]:
            return float(t[i] + (level - y[i]) / (y[i + 1] - y[i]) * (t[i + 1] - t[i]))
    return None


def edges(t: np.ndarray, y: np.ndarray, low: float, high: float) -> list[float]:
    """Signed rate of every complete traversal between the 10 and 90 percent levels."""
    marks = []
    for level, name in ((low, "low"), (high, "high")):
        fall, rise = crossing_indices(y, level)
        for i, up in [(i, True) for i in rise] + [(i, False) for i in fall]:
            if t[i + 1] > t[i]:
                marks.append((t[i] + (level - y[i]) / (y[i + 1] - y[i]) * (t[i + 1] - t[i]), name, up))
    marks.sort()
    out, pending = [], None
    for at, name, up in marks:
        if up == (name == "low"):  # enters the band
            pending = (at, up)
        elif pending and pending[1] == up and at > pending[0]:
            out.append((high - low) / (at - pending[0]) * (1 if up else -1))
            pending = None
        else:
            pending = None
    return out


TRAN_METRICS = ("y0", "y1", "rise_time", "fall_time", "overshoot_pct", "settling_time", "slew_rate", "slew_rate_worst", "edge_count", "t50", "prop_delay", "final")


def tran_metrics(t: np.ndarray, y: np.ndarray, drive: np.ndarray | None = None) -> tuple[dict[str, float], dict[str, str]]:
    """(metrics, notes) of a transient record; `drive` on the same time axis gives the delay."""
    t, y = np.asarray(t, float), np.asarray(y, float)
    if len(y) < 2:
        return {}, {"all": "few_samples"}
    lv = levels(t, y)
    out: dict[str, float] = {"final": float(y[-1])}
    notes = {"levels": lv["note"]} if lv["note"] else {}
    if lv["kind"] in ("flat", "unsettled"):
        notes["all"] = lv["kind"]
        return out, notes
    if drive is not None:
        dv = levels(t, np.asarray(drive, float))
        if dv["kind"] == "pulse" and len(y) >= 4:
            # the output must have settled by the end of the drive's own first plateau
            ratio = settle_ratio(t, y, dv["end"], max(2, int((dv["end"] + 1) * WINDOW)))
            if ratio is not None and ratio > SETTLE_RATE:
                notes["all"] = "drive_ended_first"
                return out, notes
    y0, y1, end = lv["y0"], lv["y1"], lv["end"]
    step = y1 - y0
    out |= {"y0": y0, "y1": y1}
    low, high = y0 + 0.1 * step, y0 + 0.9 * step
    up = step > 0
    a = crossing_time(t, y, low, up, 0, end)
    b = crossing_time(t, y, high, up, 0, end)
    if a is not None and b is not None and b > a:
        out["rise_time" if up else "fall_time"] = b - a
        out["slew_rate"] = 0.8 * step / (b - a)
    region = y[: end + 1]
    past = np.nanmax(np.sign(step) * (region - y1))
    out["overshoot_pct"] = 0.0 if lv["monotone"] else float(max(0.0, past) / abs(step) * 100)
    outside = np.flatnonzero(np.abs(region - y1) > 0.02 * abs(step))
    if not len(outside):
        out["settling_time"] = float(t[0])
    elif outside[-1] + 1 < end:
        out["settling_time"] = float(t[outside[-1] + 1])
    else:
        notes["settling_time"] = "never_settles"
    rates = edges(t, y, min(low, high), max(low, high))
    out["edge_count"] = float(len(rates))
    if rates:
        out["slew_rate_worst"] = min(abs(r) for r in rates)
    elif "slew_rate" in out:
        out["slew_rate_worst"] = abs(out["slew_rate"])
    half = crossing_time(t, y, y0 + 0.5 * step, up, 0, end)
    if half is not None:
        out["t50"] = half
        if drive is not None and dv["kind"] in ("step", "pulse"):
            rise = dv["y1"] > dv["y0"]
            d50 = crossing_time(t, np.asarray(drive, float), (dv["y0"] + dv["y1"]) / 2, rise, 0, dv["end"])
            if d50 is not None:
                out["prop_delay"] = half - d50
    return out, notes


def _schema(names) -> str:
    return "run long, " + ", ".join(f"{n} double" for n in names) + ", notes map<string,string>"


def _frame(run, names, metrics, notes) -> pd.DataFrame:
    return pd.DataFrame([[run, *[metrics.get(n) for n in names], notes]], columns=["run", *names, "notes"]).astype({n: "float64" for n in names})


def ac(responses: DataFrame) -> DataFrame:
    """One row of AC metrics per run of responses (run, f, gain_db, phase_deg or null)."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("f", kind="stable")
        phase = pdf["phase_deg"].to_numpy(float)
        m, n = ac_metrics(pdf["f"].to_numpy(float), pdf["gain_db"].to_numpy(float), None if np.isnan(phase).all() else phase)
        return _frame(int(pdf["run"].iloc[0]), AC_METRICS, m, n)

    rows = responses.filter("run is not null and f is not null").select(F.col("run").cast("long").alias("run"), "f", "gain_db", "phase_deg")
    return rows.groupBy("run").applyInPandas(kernel, _schema(AC_METRICS))


def tran(records: DataFrame) -> DataFrame:
    """One row of transient metrics per run of records (run, t, y, drive or null)."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        drive = pdf["drive"].to_numpy(float)
        m, n = tran_metrics(pdf["t"].to_numpy(float), pdf["y"].to_numpy(float), None if np.isnan(drive).all() else drive)
        return _frame(int(pdf["run"].iloc[0]), TRAN_METRICS, m, n)

    rows = records.filter("run is not null and t is not null").select(F.col("run").cast("long").alias("run"), "t", "y", "drive")
    return rows.groupBy("run").applyInPandas(kernel, _schema(TRAN_METRICS))
