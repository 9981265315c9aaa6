"""Waveform kernels on records built from the supplier table, piecewise linear so that SQL knows
every metric in closed form: responses in log10(f), transients in t."""

from __future__ import annotations

from pyspark.sql import functions as F

from circuitlake.operators import results as res
from circuitlake.operators import waveforms
from circuitlake.runtime import table

_DT = 1e-8


def _sweep(spark, d, points=161):
    """(k, f): 20 samples a decade from 1 Hz to 100 MHz per supplier."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return s.select("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("f", F.pow(F.lit(10.0), F.col("i") / 20.0))


def _loop(spark, d):
    """A pole at f1, phase falling from 10 f1; every other loop is inverted; phases are wrapped."""
    r = _sweep(spark, d).withColumn("g", 23.0 + F.col("k") % 40).withColumn("f1", 100.0 * (1 + F.col("k") % 7))
    gain = F.col("g") - 20 * F.greatest(F.lit(0.0), F.log10(F.col("f") / F.col("f1")))
    phase = 180.0 * (F.col("k") % 2) - 90 * F.least(F.lit(2.5), F.greatest(F.lit(0.0), F.log10(F.col("f") / (10 * F.col("f1")))))
    wrapped = F.pmod(phase + 180.0, F.lit(360.0)) - 180.0
    return r.select(F.col("k").alias("run"), "f", gain.alias("gain_db"), wrapped.alias("phase_deg"))


def _round(df, names, digits=5):
    return df.select("run", *[F.format_string(f"%.{digits}e", n).try_cast("double").alias(n) for n in names])


def loops(spark, d):
    names = ("dc_gain_db", "low_freq_gain_db", "peak_gain_db", "passband_gain_db", "bandwidth_3db", "f_3db_hi", "ugb", "phase_margin", "gain_margin", "f_180", "inversions", "rolloff")
    return _round(waveforms.ac(_loop(spark, d)), names)


def bands(spark, d):
    """Band-pass responses: no gain at DC, so the flat band is the reference."""
    r = _sweep(spark, d).withColumn("g", 20.0 + F.col("k") % 30).withColumn("fl", F.pow(F.lit(10.0), 1 + 0.1 * (F.col("k") % 5)))
    gain = F.col("g") - 20 * F.greatest(F.lit(0.0), F.log10(F.col("fl") / F.col("f"))) - 20 * F.greatest(F.lit(0.0), F.log10(F.col("f") / (F.col("fl") * 1e4)))
    got = waveforms.ac(r.select(F.col("k").alias("run"), "f", gain.alias("gain_db"), F.lit(None).cast("double").alias("phase_deg")))
    note = got.select(F.col("run").alias("r"), F.try_element_at("notes", F.lit("dc_gain_db")).alias("dc"), F.try_element_at("notes", F.lit("bandwidth_3db")).alias("band"))
    return _round(got, ("dc_gain_db", "passband_gain_db", "f_3db_lo", "f_3db_hi", "bandwidth_3db", "low_slope")).join(note, F.col("run") == F.col("r")).drop("r")


def leads(spark, d):
    """Flat gain with a phase that leads as 1 / f: the sweep does not show the gain at DC."""
    r = _sweep(spark, d, 61).withColumn("lead", F.when(F.col("k") % 2 == 0, 30.0 / F.col("f")).otherwise(0.0) - 0.001 * F.col("f"))
    got = waveforms.ac(r.select(F.col("k").alias("run"), "f", F.lit(20.0).alias("gain_db"), F.col("lead").alias("phase_deg")))
    return got.select("run", "dc_gain_db", F.try_element_at("notes", F.lit("dc_gain_db")).alias("note"))


def stability(spark, d):
    """Loop gain as out over in: the gain is put on out, in is a constant."""
    r = _loop(spark, d)
    mag, rad = F.pow(F.lit(10.0), F.col("gain_db") / 20), F.radians("phase_deg")
    out = r.select("run", F.col("f").alias("x"), (2 * mag * F.cos(rad)).alias("re"), (2 * mag * F.sin(rad)).alias("im"))
    one = r.select("run", F.col("f").alias("x"), F.lit(2.0).alias("re"), F.lit(0.0).alias("im"))
    got = res.stability(out, one)
    return _round(got, ("phase_margin", "gain_margin", "ugb"), 4).join(got.select(F.col("run").alias("r"), "reason"), F.col("run") == F.col("r")).drop("r")


def _time(spark, d, n=1001):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    r = s.select("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    r = r.withColumn("a", F.when(F.col("k") % 2 == 0, 1.0).otherwise(-1.0) * (1 + F.col("k") % 5)).withColumn("b", (F.col("k") % 3).cast("double"))
    return r.withColumn("at", 200 + F.col("k") % 50).withColumn("r", 41 + 10 * (F.col("k") % 7))


def _ramp(at, over):
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("i") - at) / over))


def _tran(rows, y, drive=None):
    return waveforms.tran(rows.select(F.col("k").alias("run"), (F.col("i") * _DT).alias("t"), y.alias("y"), (F.lit(None).cast("double") if drive is None else drive).alias("drive")))


def steps(spark, d):
    r = _time(spark, d)
    got = _tran(r, F.col("b") + F.col("a") * _ramp(F.col("at"), F.col("r")), _ramp(F.lit(100), F.lit(20)))
    return _round(got, ("y0", "y1", "rise_time", "fall_time", "overshoot_pct", "settling_time", "slew_rate", "slew_rate_worst", "edge_count", "t50", "prop_delay", "final"))


def pulses(spark, d):
    """Up within r samples, a plateau of 300, back within 2 r."""
    r = _time(spark, d)
    got = _tran(r, F.col("b") + F.col("a") * (_ramp(F.col("at"), F.col("r")) - _ramp(F.col("at") + F.col("r") + 300, 2 * F.col("r"))))
    note = got.select(F.col("run").alias("k"), F.try_element_at("notes", F.lit("levels")).alias("levels"))
    return _round(got, ("y0", "y1", "rise_time", "fall_time", "slew_rate", "slew_rate_worst", "edge_count", "final")).join(note, F.col("run") == F.col("k")).drop("k")


def overshoots(spark, d):
    """Beyond the level by a share of k percent, and back to it."""
    r = _time(spark, d).withColumn("o", 0.03 + (F.col("k") % 10) / 100)
    got = _tran(r, F.col("b") + F.col("a") * ((1 + F.col("o")) * _ramp(F.col("at"), F.col("r")) - F.col("o") * _ramp(F.col("at") + F.col("r"), F.lit(50))))
    return _round(got, ("y1", "overshoot_pct"))


def refusals(spark, d):
    """Constant records, ramps that never end, and outputs still moving when their drive ends."""
    r = _time(spark, d)
    kind = F.col("k") % 4
    slow = F.least(F.lit(0.3), F.greatest(F.lit(0.0), (F.col("i") - 200) / 1000))
    y = F.when(kind == 0, 1.5).when(kind == 1, F.col("i") / 1000).when(kind == 2, slow).otherwise(_ramp(F.lit(200), F.lit(40)))
    drive = F.when(kind == 2, _ramp(F.lit(200), F.lit(5)) - _ramp(F.lit(500), F.lit(5))).otherwise(_ramp(F.lit(150), F.lit(5)))
    got = _tran(r, y, drive)
    return got.select("run", F.try_element_at("notes", F.lit("all")).alias("refused"), F.try_element_at("notes", F.lit("levels")).alias("levels"), F.round("final", 6).alias("final"))


QUERIES = {
    "wave_loops": loops, "wave_bands": bands, "wave_leads": leads, "wave_stability": stability, "wave_steps": steps, "wave_pulses": pulses,
    "wave_overshoots": overshoots, "wave_refusals": refusals,
}

_DB3 = "(10 * log10(2))"
_S = "s AS (SELECT s_suppkey AS run, s_suppkey AS k FROM supplier)"
_P = f"{_S}, p AS (SELECT run, k, 23.0::DOUBLE + k % 40 AS g, 100.0::DOUBLE * (1 + k % 7) AS f1 FROM s), q AS (SELECT *, f1 * pow(10, g / 20) AS u FROM p)"
_T = f"{_S}, p AS (SELECT run, k, (CASE WHEN k % 2 = 0 THEN 1.0 ELSE -1.0 END * (1 + k % 5))::DOUBLE AS a, (k % 3)::DOUBLE AS b, 200 + k % 50 AS t1, 41 + 10 * (k % 7) AS r FROM s)"


def _e(digits=5, **columns):
    return ", ".join(f"printf('%.{digits}e', ({x})::DOUBLE)::DOUBLE AS {n}" for n, x in columns.items())


SQL = {
    "wave_loops": f"""WITH {_P} SELECT run, {_e(dc_gain_db="g", low_freq_gain_db="g", peak_gain_db="g", passband_gain_db="g", bandwidth_3db=f"f1 * pow(10, {_DB3} / 20)", f_3db_hi=f"f1 * pow(10, {_DB3} / 20)", ugb="u", phase_margin="180 - 90 * (g / 20 - 1)", gain_margin="60 - g", f_180="f1 * 1000", inversions="0 - k % 2", rolloff="-20")} FROM q""",
    "wave_bands": f"""WITH {_S}, p AS (SELECT run, 20.0::DOUBLE + k % 30 AS g, pow(10, 1 + 0.1::DOUBLE * (k % 5)) AS fl FROM s)
SELECT run, NULL::DOUBLE AS dc_gain_db, {_e(passband_gain_db="g", f_3db_lo=f"fl / pow(10, {_DB3} / 20)", f_3db_hi=f"fl * 1e4 * pow(10, {_DB3} / 20)", bandwidth_3db=f"fl * 1e4 * pow(10, {_DB3} / 20)", low_slope="20")}, 'slopes_at_start' AS dc, 'band_pass' AS band FROM p""",
    "wave_leads": f"WITH {_S} SELECT run, CASE WHEN k % 2 = 1 THEN 20.0::DOUBLE END AS dc_gain_db, CASE WHEN k % 2 = 0 THEN 'phase_leads_at_start' END AS note FROM s",
    "wave_stability": f"""WITH {_P} SELECT run, {_e(4, phase_margin="180 - 90 * (g / 20 - 1)", gain_margin="60 - g", ugb="u")}, NULL::VARCHAR AS reason FROM q""",
    "wave_steps": f"""WITH {_T} SELECT run, {_e(y0="b", y1="a + b", rise_time="CASE WHEN a > 0 THEN 0.8 * r * 1e-8 END", fall_time="CASE WHEN a < 0 THEN 0.8 * r * 1e-8 END", overshoot_pct="0", settling_time="(t1 + ceil(0.98 * r)) * 1e-8",
  slew_rate="a / (r * 1e-8)", slew_rate_worst="abs(a) / (r * 1e-8)", edge_count="1", t50="(t1 + r / 2.0) * 1e-8", prop_delay="(t1 + r / 2.0 - 110) * 1e-8", final="a + b")} FROM p""",
    "wave_pulses": f"""WITH {_T} SELECT run, {_e(y0="b", y1="a + b", rise_time="CASE WHEN a > 0 THEN 0.8 * r * 1e-8 END", fall_time="CASE WHEN a < 0 THEN 0.8 * r * 1e-8 END", slew_rate="a / (r * 1e-8)", slew_rate_worst="abs(a) / (2 * r * 1e-8)", edge_count="2", final="b")}, 'returns_to_start' AS levels FROM p""",
    "wave_overshoots": f"""WITH {_T} SELECT run, {_e(y1="a + b", overshoot_pct="3 + k % 10")} FROM p""",
    "wave_refusals": f"""WITH {_S} SELECT run, ['flat', 'unsettled', 'drive_ended_first', NULL][k % 4 + 1] AS refused, ['constant', 'still_moving', NULL, NULL][k % 4 + 1] AS levels, [1.5, 1.0, 0.3, 1.0][k % 4 + 1]::DOUBLE AS final FROM s""",
}
