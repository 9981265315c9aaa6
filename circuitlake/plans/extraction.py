"""Extraction query: station means as SI metrics of tasks, brought to the tasks' spec units."""

from __future__ import annotations

from pyspark.sql import functions as F

from circuitlake.operators import extraction, scoring
from circuitlake.runtime import table


def _metrics(spark, d):
    m = table(spark, d, "meas_result").filter("task_id is not null").select("task_id", "metric", "value", "meas_id").distinct()
    good = F.when(~F.isnan("value"), F.col("value") * 1e-6)
    return m.groupBy("task_id", "metric").agg(F.avg(good).alias("si"), F.when(F.count(good) == 0, "measurement_failed").alias("note"))


def extract(spark, d):
    specs = scoring.explode_specs(table(spark, d, "eval_task")).select("task_id", "spec", "unit")
    kinds = table(spark, d, "eval_task").select(F.col("id").alias("task_id"), F.when(F.col("category") == "analog", "v").alias("input"), F.lit("v").alias("output"))
    out = extraction.extract(specs, _metrics(spark, d), kinds)
    return out.select("task_id", "spec", "metric", F.format_string("%.8e", F.col("value") * 1.0471975511965976).try_cast("double").alias("value"), "reason")


QUERIES = {"extract_specs": extract}

# Written out here, so that the check does not read the tables it checks.
_ALIAS = """al(alias, metric, dimension) AS (VALUES ('gain', 'passband_gain_db', 'gain'), ('dc_gain', 'dc_gain_db', 'gain'), ('gain_db', 'passband_gain_db', 'gain'), ('conversion_gain', 'passband_gain_db', 'gain'), ('gain_max', 'passband_gain_db', 'gain'), ('gain_min', 'passband_gain_db', 'gain'),
  ('linearity', 'passband_gain_db', 'gain'), ('ugb', 'ugb', 'frequency'), ('gbw', 'ugb', 'frequency'), ('bw', 'bandwidth_3db', 'frequency'), ('bandwidth', 'bandwidth_3db', 'frequency'), ('cutoff_freq', 'bandwidth_3db', 'frequency'),
  ('pm', 'phase_margin', 'angle'), ('phase_margin', 'phase_margin', 'angle'), ('gain_margin', 'gain_margin', 'gain_db_only'), ('idd', 'idd', 'current'), ('iq', 'idd', 'current'), ('idd_quiescent', 'idd', 'current'),
  ('idd_1ghz', 'idd', 'current'), ('i_supply', 'idd', 'current'), ('vout', 'vout', 'voltage'), ('v_out', 'vout', 'voltage'), ('vref', 'vout', 'voltage'), ('output_swing', 'output_swing', 'voltage'),
  ('vout_swing', 'output_swing', 'voltage'), ('swing', 'output_swing', 'voltage'), ('max_gain', 'dc_max_slope', 'gain_vv'), ('dc_slope', 'dc_max_slope', 'gain_vv'), ('vtc_gain', 'dc_max_slope', 'gain_vv'), ('iout_max', 'iout_max', 'current'),
  ('iout_swing', 'iout_swing', 'current'), ('output_tc', 'output_tc', 'tc_voltage'), ('vout_final', 'vout_final', 'voltage'), ('final_value', 'vout_final', 'voltage'), ('osc_freq', 'osc_freq', 'frequency'), ('oscillation_frequency', 'osc_freq', 'frequency'),
  ('fosc', 'osc_freq', 'frequency'), ('slew_rate', 'slew_rate', 'slew'), ('settling_time', 'settling_time', 'time'), ('settling', 'settling_time', 'time'), ('delay', 'prop_delay', 'time'), ('rise_time', 'rise_time', 'time'),
  ('fall_time', 'fall_time', 'time'), ('overshoot', 'overshoot_pct', 'percent'), ('noise', 'input_noise_density', 'noise_density'), ('input_noise', 'input_noise_density', 'noise_density'), ('output_noise', 'output_noise_density', 'noise_density'), ('noise_rms', 'input_noise_rms', 'noise_rms'))"""
_SCALE = """sc(family, u, scale) AS (VALUES ('frequency', 'hz', 1.0::DOUBLE), ('frequency', 'khz', 1000.0::DOUBLE), ('frequency', 'mhz', 1000000.0::DOUBLE), ('frequency', 'ghz', 1000000000.0::DOUBLE), ('frequency', 'thz', 1000000000000.0::DOUBLE), ('frequency', 'sa/s', 1.0::DOUBLE),
  ('current', 'a', 1.0::DOUBLE), ('current', 'ma', 0.001::DOUBLE), ('current', 'ua', 1e-06::DOUBLE), ('current', 'na', 1e-09::DOUBLE), ('current', 'pa', 1e-12::DOUBLE), ('voltage', 'v', 1.0::DOUBLE),
  ('voltage', 'mv', 0.001::DOUBLE), ('voltage', 'uv', 1e-06::DOUBLE), ('voltage', 'nv', 1e-09::DOUBLE), ('time', 's', 1.0::DOUBLE), ('time', 'ms', 0.001::DOUBLE), ('time', 'us', 1e-06::DOUBLE),
  ('time', 'ns', 1e-09::DOUBLE), ('time', 'ps', 1e-12::DOUBLE), ('time', 'fs', 1e-15::DOUBLE), ('tc_voltage', 'v/c', 1.0::DOUBLE), ('tc_voltage', 'mv/c', 0.001::DOUBLE), ('tc_voltage', 'uv/c', 1e-06::DOUBLE),
  ('noise_density_v', 'v/sqrt(hz)', 1.0::DOUBLE), ('noise_density_v', 'uv/sqrt(hz)', 1e-06::DOUBLE), ('noise_density_v', 'nv/sqrt(hz)', 1e-09::DOUBLE), ('noise_density_i', 'a/sqrt(hz)', 1.0::DOUBLE), ('noise_density_i', 'na/sqrt(hz)', 1e-09::DOUBLE), ('noise_density_i', 'pa/sqrt(hz)', 1e-12::DOUBLE),
  ('noise_density_i', 'fa/sqrt(hz)', 1e-15::DOUBLE), ('slew', 'v/s', 1.0::DOUBLE), ('slew', 'v/ms', 1000.0::DOUBLE), ('slew', 'v/us', 1000000.0::DOUBLE), ('slew', 'v/ns', 1000000000.0::DOUBLE), ('angle', 'deg', 1.0::DOUBLE),
  ('angle', 'degrees', 1.0::DOUBLE), ('angle', 'degree', 1.0::DOUBLE), ('angle', '', 1.0::DOUBLE), ('percent', '%', 1.0::DOUBLE), ('percent', 'percent', 1.0::DOUBLE), ('percent', '', 1.0::DOUBLE),
  ('gain_db_only', 'db', 1.0::DOUBLE), ('gain_db_only', '', 1.0::DOUBLE), ('gain_vv', 'v/v', 1.0::DOUBLE), ('gain_vv', '', 1.0::DOUBLE))"""
SQL = {
    "extract_specs": f"""WITH {_ALIAS}, {_SCALE},
  s AS (SELECT t.id AS task_id, t.category, e.key AS spec, lower(trim(coalesce(e.value.unit, ''))) AS u FROM (SELECT *, unnest(map_entries(specs)) AS e FROM eval_task) t),
  m AS (SELECT task_id, metric, avg(CASE WHEN NOT isnan(value) THEN value * 1e-6 END) AS si, CASE WHEN count(CASE WHEN NOT isnan(value) THEN 1 END) = 0 THEN 'measurement_failed' END AS note
        FROM (SELECT DISTINCT task_id, metric, value, meas_id FROM meas_result WHERE task_id IS NOT NULL) GROUP BY ALL),
  j AS (SELECT s.*, al.metric, al.dimension, m.si, m.note, CASE WHEN category = 'analog' THEN 'v' END AS kin FROM s LEFT JOIN al ON al.alias = lower(trim(s.spec)) LEFT JOIN m ON m.task_id = s.task_id AND m.metric = al.metric),
  f AS (SELECT *, CASE WHEN dimension = 'noise_density' THEN 'noise_density_' || CASE WHEN metric = 'output_noise_density' THEN 'v' ELSE kin END WHEN dimension = 'noise_rms' THEN CASE kin WHEN 'v' THEN 'voltage' END ELSE dimension END AS family FROM j),
  g AS (SELECT f.*, scale FROM f LEFT JOIN sc ON sc.family = f.family AND sc.u = f.u),
  r AS (SELECT *, CASE WHEN u IN ('bool', 'bits', 'lsb', 'cycles', 'years', 'um2') THEN 'non_analog_unit' WHEN metric IS NULL THEN 'unknown_spec' WHEN family IS NULL THEN 'no_noise_kind'
     WHEN CASE WHEN dimension = 'gain' THEN u NOT IN ('db', '', 'v/v', 'vv', 'ratio') ELSE scale IS NULL END THEN 'wrong_unit' WHEN si IS NULL THEN coalesce(note, 'not_measured') END AS reason FROM g)
SELECT task_id, spec, metric, CASE WHEN reason IS NULL THEN printf('%.8e', CASE WHEN dimension = 'gain' THEN CASE WHEN u IN ('db', '') THEN si ELSE pow(10, si / 20) END ELSE si / scale END * 1.0471975511965976::DOUBLE)::DOUBLE END AS value, reason FROM r"""
}
