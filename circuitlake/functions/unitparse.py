"""Unit strings: segmentation by dynamic programming over tries.

A unit is read as factors joined by separators; a factor is an optional prefix, a
root and an optional exponent. Prefixes, roots, exponents and separators live in
tries; `readings` walks all of them from every position (dynamic programming over
(position, state) keeping the best readings per dimension), scores each whole
segmentation, and `parse` picks the best one under a prior for the dimension the
field is known to have. Letter case is only weak evidence: the score of a reading
drops with each letter whose case differs, so `MV` is millivolts for a voltage (the
prefix table below forbids mega there) and `Mohm` and `mohm` stay apart.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

# SI prefixes used with electrical units.
PREFIXES = {
    "f": -15, "p": -12, "n": -9, "u": -6, "m": -3, "k": 3, "M": 6, "G": 9, "T": 12,
    "femto": -15, "pico": -12, "nano": -9, "micro": -6, "milli": -3, "kilo": 3, "mega": 6, "giga": 9, "tera": 12,
}

# Unit roots as (spellings, symbol). Plurals are handled by a rule.
ROOTS = {
    "V": ("V", "volt"), "A": ("A", "amp", "ampere"), "s": ("s", "sec", "second"), "Hz": ("Hz", "hertz"),
    "W": ("W", "watt"), "F": ("F", "farad"), "ohm": ("ohm", "Ω"), "rad": ("rad", "radian"),
    "deg": ("deg", "degree", "°"), "dB": ("dB", "decibel", "dB20"), "dBm": ("dBm", "dB(mW)"),
    "ratio": ("V/V", "x", "lin", "ratio"), "K": ("K", "kelvin"),
    "degC": ("C", "degC", "°C", "celsius"), "degF": ("F", "degF", "°F", "fahrenheit"),
    "rtHz": ("rtHz", "√Hz", "sqrt(Hz)", "Hz^0.5", "√(Hz)"),
}

SEPARATORS = {"/": -1, " / ": -1, " per ": -1, "·": 1, "*": 1, " ": 1}
EXPONENTS = {"^-0.5": -0.5, "^-1/2": -0.5, "^0.5": 0.5, "^1/2": 0.5, "^-1": -1.0, "^1": 1.0, "^2": 2.0}

#: Dimension of the powers of roots that make it up (after sorting).
DIMENSIONS = {
    (("A", 1.0),): "current", (("V", 1.0),): "voltage", (("Hz", 1.0),): "frequency", (("s", 1.0),): "time",
    (("s", -1.0),): "frequency", (("dB", 1.0),): "gain", (("ratio", 1.0),): "gain", (("deg", 1.0),): "angle",
    (("rad", 1.0),): "angle", (("V", 1.0), ("s", -1.0)): "slew", (("W", 1.0),): "power", (("dBm", 1.0),): "power",
    (("ohm", 1.0),): "resistance", (("F", 1.0),): "capacitance", (("K", 1.0),): "temperature",
    (("degC", 1.0),): "temperature", (("degF", 1.0),): "temperature", (("V", 1.0), ("rtHz", -1.0)): "noise",
    (("Hz", -0.5), ("V", 1.0)): "noise",
}

#: Roots that never carry a prefix above unity, and roots that never carry milli.
NO_LARGE = {"V", "A", "W", "s", "F", "dB", "dBm", "deg", "rad", "degC", "K", "degF", "rtHz", "ratio"}
NO_MILLI = {"Hz"}
NO_PREFIX = {"ratio", "dBm", "degF", "rtHz"}
#: Roots whose prefix's letter case decides (milliohm against megohm).
CASED = {"ohm"}


class Trie:
    """Case-folded trie; values keep the spelling so that case can be scored."""

    def __init__(self, entries: list[tuple[str, object]]):
        self.root: dict = {}
        for text, value in entries:
            node = self.root
            for ch in text.lower():
                node = node.setdefault(ch, {})
            node.setdefault("", []).append((text, value))

    def walk(self, text: str, at: int):
        node = self.root
        for end in range(at, len(text) + 1):
            for spelling, value in node.get("", ()):
                yield end, spelling, value
            if end == len(text) or text[end].lower() not in node:
                return
            node = node[text[end].lower()]


_PREFIX = Trie(list(PREFIXES.items()))
_ROOT = Trie([(s, sym) for sym, spellings in ROOTS.items() for s in spellings])
_SEP = Trie(list(SEPARATORS.items()))
_EXP = Trie(list(EXPONENTS.items()))


@dataclass(frozen=True)
class Reading:
    factors: tuple[tuple[str, float], ...]
    power: float
    score: float

    @property
    def dimension(self) -> str | None:
        return DIMENSIONS.get(self.factors)


def clean(text: str | None) -> str:
    """Compatibility-normalised, blanks squeezed; micro and ohm signs unified."""
    if text is None:
        return ""
    text = unicodedata.normalize("NFKC", text).replace("μ", "u").replace("µ", "u").replace("Ω", "Ω")
    return re.sub(r"\s+", " ", text).strip()


def _factor(text: str, at: int):
    """All (end, root, power of ten, score) of one factor starting at `at`."""
    starts = [(at, "", 0, 0.0)]
    starts += [(end, p, exp, 0.0) for end, p, exp in _PREFIX.walk(text, at) if end > at]
    for start, prefix, exp, _ in starts:
        for end, spelling, root in _ROOT.walk(text, start):
            if end == start:
                continue
            if prefix:
                seen = text[at:start]
                if root in NO_PREFIX or (root == "degC" and spelling.lower() not in ("c", "degc", "celsius", "°c")):
                    continue
                if len(prefix) == 1 and seen.lower() == "m":
                    if root in NO_LARGE and exp > 0 or root in NO_MILLI and exp < 0:
                        continue
                    if root in CASED and seen != prefix:
                        continue
                elif exp > 0 and root in NO_LARGE:
                    continue
                if (len(prefix) == 1) != (len(spelling) <= 4):
                    score = -1.5
                else:
                    score = -0.2
                score -= 0.3 * sum(a != b for a, b in zip(seen, prefix, strict=True))
            else:
                score = 0.0
            score -= 0.3 * sum(a != b for a, b in zip(text[start:end], spelling, strict=True))
            score += 0.1 * len(spelling)
            ends = [end]
            if len(spelling) > 2 and spelling[0].isalpha() and text[end : end + 1].lower() == "s":
                ends.append(end + 1)
            for e in ends:
                yield e, root, 1.0, float(exp), score
                for e2, _, power in _EXP.walk(text, e):
                    if e2 > e:
                        yield e2, root, power, exp * power, score


@lru_cache(maxsize=65536)
def readings(unit: str) -> tuple[Reading, ...]:
    """Every segmentation of the whole string with a known dimension, best first."""
    text = clean(unit)
    if not text:
        return ()
    best: list[dict] = [{} for _ in range(len(text) + 1)]
    best[0][(1, ())] = (0.0, 0.0)
    for at in range(len(text)):
        for (sign, factors), (power, score) in list(best[at].items()):
            if sign == 0:
                for end, _, s in _SEP.walk(text, at):
                    if end > at:
                        _keep(best[end], (s, factors), (power, score - 0.1))
                continue
            for end, root, n, ten, got in _factor(text, at):
                merged = dict(factors)
                merged[root] = merged.get(root, 0.0) + sign * n
                key = tuple(sorted((r, p) for r, p in merged.items() if p))
                _keep(best[end], (0, key), (power + sign * ten, score + got))
    out = {}
    for key, (power, score) in best[-1].items():
        if key[0] == 0:
            reading = Reading(key[1], power, score)
            if reading.dimension and (key[1] not in out or out[key[1]].score < score):
                out[key[1]] = reading
    return tuple(sorted(out.values(), key=lambda r: -r.score))


def _keep(cell: dict, key: tuple, value: tuple[float, float]) -> None:
    if key not in cell or cell[key][1] < value[1]:
        cell[key] = value


@lru_cache(maxsize=65536)
def parse(unit: str | None, prior: str | None = None, weight: float = 2.0) -> Reading | None:
    """The best reading under a prior that the dimension is `prior`; None if unreadable."""
    found = readings(unit or "")
    return max(found, key=lambda r: r.score + weight * (r.dimension == prior)) if found else None


def to_base(value: float, reading: Reading) -> float | None:
    """Value in the dimension's base unit (V, A, Hz, s, dB, degree, V/s, W, ohm, F, degree Celsius, V/sqrt(Hz))."""
    roots = dict(reading.factors)
    x = value * 10.0**reading.power if reading.power >= 0 else value / 10.0**-reading.power
    if "ratio" in roots:
        return 20.0 * math.log10(x) if x > 0 else None
    if "rad" in roots:
        return math.degrees(x)
    if "dBm" in roots:
        return 10.0 ** (x / 10.0) / 1000.0 if x < 3000 else None
    if "K" in roots:
        return x - 273.15
    if "degF" in roots:
        return (x - 32.0) * 5.0 / 9.0
    return x


def same_unit(a: Reading, b: Reading) -> bool:
    """Whether two readings are spellings of one unit."""
    def kind(r):
        roots = dict(r.factors)
        if roots.get("Hz") == -0.5:
            roots.pop("Hz")
            roots["rtHz"] = -1.0
        return tuple(sorted(roots.items()))

    return kind(a) == kind(b) and abs(a.power - b.power) < 1e-9


def from_base(value: float, common: Reading) -> float:
    return value / 10.0**common.power if common.power >= 0 else value * 10.0**-common.power
