"""Queries of the unit operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from circuitlake.operators import units
from circuitlake.runtime import table


def _tables(spark, sf_dir):
    return [table(spark, sf_dir, n) for n in ("meas_result", "metric_unit", "meas_source")]


def given(spark, sf_dir):
    """Measurements that state both number and unit themselves, converted."""
    m, metrics, sources = _tables(spark, sf_dir)
    rows = m.filter("value is not null and not isnan(value) and abs(value) < double('inf') and regexp_replace(unit, '[-\\\\s]', '') <> ''")
    return units.convert(rows, metrics, sources).select("meas_id", "status", "common_value").distinct()


QUERIES = {
    "p4_found": lambda spark, sf_dir: units.converted(*_tables(spark, sf_dir)),
    "p4_given": given,
    "p4_status": lambda spark, sf_dir: units.convert(*_tables(spark, sf_dir)).groupBy("source", "status").agg(F.count(F.lit(1)).alias("count")),
}

# Spellings in the tables with kind and power of ten, found by looking at them, not by the parser under test.
_SPELLED = """sp(dimension, spelling, kind, p) AS (VALUES
  ('angle', 'mdeg', 'deg', -3), ('angle', 'deg', 'deg', 0), ('angle', 'degree', 'deg', 0), ('angle', 'degrees', 'deg', 0), ('angle', '°', 'deg', 0), ('angle', 'rad', 'rad', 0), ('angle', 'radians', 'rad', 0),
  ('capacitance', 'pf', 'F', -12), ('capacitance', 'picofarads', 'F', -12), ('capacitance', 'femtofarads', 'F', -15), ('capacitance', 'ff', 'F', -15), ('capacitance', 'microfarads', 'F', -6),
  ('capacitance', 'uf', 'F', -6), ('capacitance', 'nanofarads', 'F', -9), ('capacitance', 'nf', 'F', -9),
  ('current', 'pa', 'A', -12), ('current', 'picoamps', 'A', -12), ('current', 'ma', 'A', -3), ('current', 'milliamps', 'A', -3), ('current', 'microamps', 'A', -6), ('current', 'ua', 'A', -6),
  ('current', 'na', 'A', -9), ('current', 'nanoamps', 'A', -9), ('current', 'a', 'A', 0), ('current', 'amps', 'A', 0),
  ('frequency', 'hertzs', 'Hz', 0), ('frequency', 'hz', 'Hz', 0), ('frequency', 'khz', 'Hz', 3), ('frequency', 'kilohertzs', 'Hz', 3), ('frequency', 'megahertzs', 'Hz', 6), ('frequency', 'mhz', 'Hz', 6),
  ('frequency', 'ghz', 'Hz', 9), ('frequency', 'gigahertzs', 'Hz', 9),
  ('gain', 'mdb', 'dB', -3), ('gain', 'db', 'dB', 0), ('gain', 'db20', 'dB', 0), ('gain', 'decibel', 'dB', 0), ('gain', 'lin', 'ratio', 0), ('gain', 'v/v', 'ratio', 0), ('gain', 'x', 'ratio', 0),
  ('noise', 'nv hz^-0.5', 'V/rtHz', -9), ('noise', 'pv/rthz', 'V/rtHz', -12), ('noise', 'pv/sqrt(hz)', 'V/rtHz', -12), ('noise', 'uv/rthz', 'V/rtHz', -6), ('noise', 'uv/sqrt(hz)', 'V/rtHz', -6), ('noise', 'uv/√hz', 'V/rtHz', -6),
  ('noise', 'nv/rthz', 'V/rtHz', -9), ('noise', 'nv/sqrt(hz)', 'V/rtHz', -9), ('noise', 'nv/√hz', 'V/rtHz', -9),
  ('power', 'milliwatts', 'W', -3), ('power', 'mw', 'W', -3), ('power', 'microwatts', 'W', -6), ('power', 'uw', 'W', -6), ('power', 'nanowatts', 'W', -9), ('power', 'nw', 'W', -9), ('power', 'w', 'W', 0), ('power', 'watts', 'W', 0),
  ('power', 'db(mw)', 'dBm', 0), ('power', 'dbm', 'dBm', 0),
  ('resistance', 'milliohms', 'ohm', -3), ('resistance', 'mohm', 'ohm', -3), ('resistance', 'mΩ', 'ohm', -3), ('resistance', 'ohm', 'ohm', 0), ('resistance', 'ohms', 'ohm', 0), ('resistance', 'Ω', 'ohm', 0),
  ('resistance', 'kiloohms', 'ohm', 3), ('resistance', 'kohm', 'ohm', 3), ('resistance', 'kΩ', 'ohm', 3), ('resistance', 'Mohm', 'ohm', 6), ('resistance', 'MΩ', 'ohm', 6), ('resistance', 'megaohms', 'ohm', 6),
  ('slew', 'v/s', 'V/s', 0), ('slew', 'mv/us', 'V/s', 3), ('slew', 'v/ms', 'V/s', 3), ('slew', 'v per us', 'V/s', 6), ('slew', 'v/us', 'V/s', 6), ('slew', 'v/ns', 'V/s', 9), ('slew', 'v/nsec', 'V/s', 9),
  ('temperature', 'k', 'K', 0), ('temperature', 'kelvin', 'K', 0), ('temperature', 'mc', 'C', -3), ('temperature', 'c', 'C', 0), ('temperature', 'celsius', 'C', 0), ('temperature', 'degc', 'C', 0), ('temperature', '°c', 'C', 0),
  ('temperature', 'degf', 'Fahrenheit', 0), ('temperature', 'f', 'Fahrenheit', 0), ('temperature', 'fahrenheit', 'Fahrenheit', 0), ('temperature', '°f', 'Fahrenheit', 0),
  ('time', 'picoseconds', 's', -12), ('time', 'ps', 's', -12), ('time', 'psec', 's', -12), ('time', 'milliseconds', 's', -3), ('time', 'ms', 's', -3), ('time', 'msec', 's', -3),
  ('time', 'microseconds', 's', -6), ('time', 'us', 's', -6), ('time', 'usec', 's', -6), ('time', 'nanoseconds', 's', -9), ('time', 'ns', 's', -9), ('time', 'nsec', 's', -9),
  ('voltage', 'millivolts', 'V', -3), ('voltage', 'mv', 'V', -3), ('voltage', 'microvolts', 'V', -6), ('voltage', 'uv', 'V', -6), ('voltage', 'nanovolts', 'V', -9), ('voltage', 'nv', 'V', -9), ('voltage', 'v', 'V', 0), ('voltage', 'volts', 'V', 0))"""
_CLEAN = "trim(regexp_replace(replace(replace(replace({x}, 'µ', 'u'), 'μ', 'u'), chr(8486), 'Ω'), '\\s+', ' ', 'g'))"
#: Only for megohms against milliohms does letter case count.
_FOLDED = "CASE WHEN {x} IN ('Mohm', 'MΩ') THEN {x} ELSE replace(lower({x}), 'ω', 'Ω') END"
SQL: dict[str, str] = {
    "p4_given": f"""WITH {_SPELLED},
  m AS (SELECT DISTINCT meas_id, metric, value, {_CLEAN.format(x="unit")} AS u FROM meas_result WHERE value IS NOT NULL AND isfinite(value) AND regexp_replace(unit, '[-\\s]', '', 'g') <> ''),
  k AS (SELECT meas_id, value, metric, {_FOLDED.format(x="u")} AS u FROM m),
  d AS (SELECT metric, dimension, common_unit, {_FOLDED.format(x=_CLEAN.format(x="common_unit"))} AS c FROM metric_unit),
  j AS (SELECT k.*, d.dimension, own.kind, own.p, goal.kind AS gk, goal.p AS q, EXISTS (SELECT 1 FROM sp WHERE sp.spelling = k.u) AS known
        FROM k LEFT JOIN d USING (metric) LEFT JOIN sp own ON own.dimension = d.dimension AND own.spelling = k.u LEFT JOIN sp goal ON goal.dimension = d.dimension AND goal.spelling = d.c),
  b AS (SELECT *, CASE WHEN p >= 0 THEN value * pow(10, p) ELSE value / pow(10, -p) END AS x FROM j),
  y AS (SELECT *, CASE kind WHEN 'ratio' THEN CASE WHEN x > 0 THEN 20 * log10(x) END WHEN 'rad' THEN degrees(x) WHEN 'dBm' THEN pow(10, x / 10) / 1000 WHEN 'K' THEN x - 273.15::DOUBLE WHEN 'Fahrenheit' THEN (x - 32) * 5 / 9 ELSE x END AS base FROM b),
  z AS (SELECT *, CASE WHEN q >= 0 THEN base / pow(10, q) ELSE base * pow(10, -q) END AS v FROM y),
  s AS (SELECT *, CASE WHEN dimension IS NULL THEN 'unknown_metric' WHEN kind IS NULL THEN CASE WHEN known THEN 'other_dimension' ELSE 'unknown_unit' END WHEN v IS NULL OR abs(v) >= 9.2e18 THEN 'out_of_range'
        WHEN kind = gk AND p = q THEN 'common' ELSE 'convert' END AS status FROM z)
SELECT DISTINCT meas_id, status, CASE WHEN status IN ('common', 'convert') THEN round_even(v, 0)::BIGINT END AS common_value FROM s""",
}
