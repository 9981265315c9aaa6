"""Quantities recorded in different units, brought to one common unit per metric.

For each measurement the number is `value`, or else the number that `metadata['text']`
gives for the metric; the unit is the one in `unit`, else the one the text states for
the reading, else the one the station's note names for the metric's dimension. Unit
strings are segmented by functions.unitparse under the prior of the metric's dimension.

Defined results for odd input: null or NaN values without a number in the text, unknown
metrics, unknown units, units of another dimension, non-positive ratios and numbers
beyond BIGINT give no row from `convert(...)` filtered on `common_value`; the row itself
is kept by `convert` with a `status`. Repeated deliveries of a meas_id give one row.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circuitlake.functions import unitparse as up
from circuitlake.runtime import small

#: Dimension tables (metric_unit, meas_source) may hold at most this many rows.
MAX_DIMENSION_ROWS = 50_000

_NUMBER = r"[-+]?(?:\d+(?:[.,]\d+)*|[.,]\d+)(?:[eE][-+]?\d+)?"
_END = r"(?=\s*(?:$|\bok\b|\bat\s|;|,\s)|\s+\()"

# Ways a text states the unit of the reading itself, most explicit first.
_STATED = [
    re.compile(r"\bunits?\s*[=:]\s*(.+?)\s*$", re.I),
    re.compile(r"\breading is\s+(.+?)\s*$", re.I),
    re.compile(r"\blogged in\s+(.+?)\s*$", re.I),
    re.compile(r"\bscale\s*:\s*(.+?)\s+at\s+\w+\s*$", re.I),
    re.compile(r"^\s*\[([^\]]+)\]"),
]

# Words of a station's note that name a dimension (plural of the dimension's noun).
_NOUNS = {
    "current": "currents?", "voltage": "voltages?", "frequency": "frequenc(?:y|ies)", "time": "times?",
    "gain": "gains?", "angle": "angles?", "slew": "slew rates?", "power": "powers?", "resistance": "resistances?",
    "capacitance": "capacitances?", "temperature": "temperatures?", "noise": "noise densit(?:y|ies)",
}
_MISSING = re.compile(r"^[\s\-–—.?_]*$|^(?:n/a|none|null|unknown)$", re.I)


def number(text: str) -> float | None:
    """A number with a decimal point or comma; of two marks the last is decimal."""
    text = text.strip()
    mantissa, _, exponent = text.partition("e") if "e" in text else text.partition("E")
    if "," in mantissa and "." in mantissa:
        mark = max(mantissa.rfind(","), mantissa.rfind("."))
        mantissa = re.sub(r"[.,]", "", mantissa[:mark]) + "." + mantissa[mark + 1 :]
    elif mantissa.count(",") == 1 or mantissa.count(".") == 1:
        mantissa = mantissa.replace(",", ".")
    else:
        mantissa = re.sub(r"[.,]", "", mantissa)
    try:
        return float(mantissa + ("e" + exponent if exponent else ""))
    except ValueError:
        return None


@lru_cache(maxsize=4096)
def _metric_patterns(metric: str) -> tuple[re.Pattern, re.Pattern]:
    name = re.escape(metric)
    quantity = re.compile(rf"(?<![A-Za-z0-9]){name}\s*(?:\([^)]*\))?\s*(?:[=:]|->|\b(?:reads?|is|was|measured)\b)?\s*({_NUMBER})\s*(.*?){_END}", re.I)
    column = re.compile(rf"(?<![A-Za-z0-9]){name}\s*(?:\([^)]*\))?\s*/\s*(.+?)(?=\s*(?:$|;|,\s))", re.I)
    return quantity, column


@lru_cache(maxsize=65536)
def read_text(text: str, metric: str) -> tuple[float | None, str | None]:
    """(number, unit string) that the text gives for the metric; either may be None."""
    text = text.replace("μ", "µ")
    quantity, column = _metric_patterns(metric)
    if m := quantity.search(text):
        unit = m.group(2).strip()
        return number(m.group(1)), unit if unit and up.readings(unit) else None
    for pattern in (column, *_STATED):
        if m := pattern.search(text):
            unit = m.group(1).strip()
            if unit and up.readings(unit):
                return None, unit
    return None, None


@lru_cache(maxsize=4096)
def read_note(note: str | None, dimension: str) -> str | None:
    """The unit a station's note names for a dimension."""
    if not note or dimension not in _NOUNS:
        return None
    noun = _NOUNS[dimension]
    for pattern in (
        rf"\b{noun}\s*\[([^\]]+)\]",
        rf"\b{noun}\s+(?:are|is)\s+(?:given\s+|recorded\s+)?in\s+(.+?)(?=,\s|;\s|\.(?:\s|$)|$)",
        rf"\b{noun}\s+defaults?\s+to\s+(.+?)(?=,\s|;\s|\.(?:\s|$)|$)",
    ):
        m = re.search(pattern, note, re.I)
        if m and up.readings(m.group(1).strip()):
            return m.group(1).strip()
    return None


@lru_cache(maxsize=262144)
def resolve_unit(unit: str | None, text_unit: str | None, note: str | None, dimension: str, common: str):
    """(reading or None, status) of the unit that holds for a row."""
    stated = None if unit is None or _MISSING.match(unit) else unit
    if stated is None:
        stated = text_unit
    if stated is None:
        stated = read_note(note, dimension)
    if stated is None:
        return None, "no_unit"
    reading = up.parse(stated, dimension)
    if reading is None:
        return None, "unknown_unit"
    if reading.dimension != dimension:
        return None, "other_dimension"
    target = up.parse(common, dimension)
    if target is None:
        return None, "unknown_unit"
    return reading, "common" if up.same_unit(reading, target) else "convert"


#: How a reading becomes a value in its dimension's base unit.
_KINDS = ("plain", "ratio", "rad", "dBm", "K", "degF")


@lru_cache(maxsize=262144)
def _plan(unit: str | None, text_unit: str | None, note: str | None, dimension: str, common: str) -> tuple[str, int, float, float]:
    """(status, kind, power of ten of the unit, that of the common unit) of one way to name a unit."""
    reading, status = resolve_unit(unit, text_unit, note, dimension, common)
    if reading is None:
        return status, -1, 0.0, 0.0
    kind = next((i for i, k in enumerate(_KINDS) if k in dict(reading.factors)), 0)
    return status, kind, reading.power, up.parse(common, dimension).power


def _scaled(x: np.ndarray, power: np.ndarray) -> np.ndarray:
    return np.where(power >= 0, x * 10.0 ** np.maximum(power, 0), x / 10.0 ** np.maximum(-power, 0))


def _convert_batch(
    value: pd.Series, unit: pd.Series, metric: pd.Series, text: pd.Series, note: pd.Series, dimension: pd.Series, common: pd.Series
) -> pd.DataFrame:
    """Ways to name a unit are resolved once each; numbers are converted column-wise."""
    n = len(value)
    x = value.to_numpy(dtype=float, na_value=np.nan).copy()
    known = np.array([isinstance(d, str) and isinstance(c, str) for d, c in zip(dimension, common, strict=True)], bool)
    stated: list[str | None] = [None] * n
    for i in np.flatnonzero(known & text.notna().to_numpy()):
        number_, stated[i] = read_text(text.iat[i], metric.iat[i])
        if np.isnan(x[i]) and number_ is not None:
            x[i] = number_
    usable = known & np.isfinite(x)
    plans: dict[tuple, int] = {}
    code = np.zeros(n, np.int64)
    u, no, d, c = (s.where(s.notna(), None).tolist() for s in (unit, note, dimension, common))
    for i in np.flatnonzero(usable):
        code[i] = plans.setdefault((u[i], stated[i], no[i], d[i], c[i]), len(plans))
    got = [_plan(*key) for key in plans] or [("no_unit", -1, 0.0, 0.0)]
    kind, power, target = (np.array([g[k] for g in got], float)[code] for k in (1, 2, 3))
    with np.errstate(all="ignore"):
        base = _scaled(np.where(usable, x, 0.0), power)
        base = np.select(
            [kind == 1, kind == 2, kind == 3, kind == 4, kind == 5],
            [np.where(base > 0, 20.0 * np.log10(np.where(base > 0, base, 1.0)), np.nan), np.degrees(base), np.where(base < 3000, 10.0 ** (np.minimum(base, 3000) / 10.0) / 1000.0, np.nan), base - 273.15, (base - 32.0) * 5.0 / 9.0],
            base,
        )
        y = np.where(target >= 0, base / 10.0 ** np.maximum(target, 0), base * 10.0 ** np.maximum(-target, 0))
        fine = usable & (kind >= 0) & np.isfinite(y) & (np.abs(y) < 9.2e18)
    status = np.where(~known, "unknown_metric", np.where(~usable, "no_number", np.array([g[0] for g in got], object)[code]))
    status = np.where(usable & (kind >= 0) & ~fine, "out_of_range", status)
    whole = np.rint(np.where(fine, y, 0.0)).astype(np.int64)
    return pd.DataFrame({"common_value": pd.array(whole, dtype="Int64").copy(), "status": status}).assign(common_value=lambda f: f["common_value"].mask(~fine))


def convert(measurements: DataFrame, metric_unit: DataFrame, meas_source: DataFrame) -> DataFrame:
    """One row per delivered measurement: meas_id, source, metric, common_unit, common_value, status.

    status: convert (changed unit), common (already there), no_number, no_unit,
    unknown_unit, other_dimension, unknown_metric or out_of_range.
    The two side tables are dimensions; they are broadcast behind a count.
    """
    convert_udf = F.pandas_udf(_convert_batch, "common_value long, status string")
    metrics = metric_unit.filter("metric is not null").groupBy("metric").agg(F.min(F.struct("dimension", "common_unit")).alias("d"))
    metrics = small(metrics.select("metric", "d.*"), MAX_DIMENSION_ROWS)
    notes = small(meas_source.filter("source is not null").groupBy("source").agg(F.min("unit_note").alias("unit_note")), MAX_DIMENSION_ROWS)
    rows = measurements.select(
        "meas_id", "source", "metric", "value", "unit", F.try_element_at("metadata", F.lit("text")).alias("text")
    )
    rows = rows.join(metrics, "metric", "left").join(notes, "source", "left")
    got = convert_udf("value", "unit", "metric", "text", "unit_note", "dimension", "common_unit")
    return rows.withColumn("got", got).select("meas_id", "source", "metric", "common_unit", "got.*")


def converted(measurements: DataFrame, metric_unit: DataFrame, meas_source: DataFrame) -> DataFrame:
    """(meas_id, common_value) of measurements whose unit was known and not the common one."""
    rows = convert(measurements, metric_unit, meas_source)
    rows = rows.filter((F.col("status") == "convert") & F.col("meas_id").isNotNull())
    return rows.groupBy("meas_id").agg(F.min("common_value").alias("common_value"))
