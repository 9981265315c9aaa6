"""Canonical form of circuit decks, so that equal circuits give equal text.

A deck's first line is a title. Comment lines (`*`), inline comments (`;`, `$`), blank
lines, letter case, white space, continuation lines (`+`), the order of cards, the order
of `key=value` parameters and the spelling of numbers carry no meaning. Everything after
`.end` is ignored. Cards inside a `.subckt` block keep the block's name.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

# Scale factors of circuit decks (letter case does not count).
SCALES = {"t": 1e12, "g": 1e9, "meg": 1e6, "k": 1e3, "mil": 25.4e-6, "m": 1e-3, "u": 1e-6, "µ": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18}

_VALUE = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)(meg|mil|[tgkmuµnpfa])?[a-zΩω°µ]*$")
#: First token that may be a value, by element letter (name and nodes come before it).
_FIRST_VALUE = {"m": 6, "q": 5, "j": 5, "d": 4, "x": 10**6}


@lru_cache(maxsize=200_000)
def number(token: str) -> str:
    """Canonical text of a deck number; other tokens come back unchanged."""
    m = _VALUE.match(token)
    if m is None:
        return token
    return f"{float(m.group(1)) * SCALES.get(m.group(2) or '', 1.0):.9g}"


@lru_cache(maxsize=200_000)
def _parameter(token: str) -> str:
    key, _, value = token.partition("=")
    return f"{key}={number(value.strip(chr(39) + chr(34) + '{}'))}"


def _card(line: str) -> str:
    tokens = re.sub(r"\s*=\s*", "=", re.sub(r"[(),]", " ", line)).split()
    head = tokens[0]
    plain = [t for t in tokens if "=" not in t]
    params = sorted(_parameter(t) for t in tokens if "=" in t)
    if head[0] == ".":
        plain = [head] + [number(t) for t in plain[1:]]
    else:
        at = _FIRST_VALUE.get(head[0], 3)
        plain = ["0" if 0 < i < at and t == "gnd" else number(t) if i >= at else t for i, t in enumerate(plain)]
        if head[0] in "vi" and len(plain) > 3 and plain[3] == "dc":
            del plain[3]
    return " ".join(plain + params)


def canonical(text: str) -> str:
    """The deck's cards in canonical spelling, sorted, one per line."""
    cards: list[str] = []
    for raw in text.split("\n")[1:]:
        line = re.split(r"[;$]", raw, maxsplit=1)[0].strip().lower()
        if not line or line[0] == "*":
            continue
        if line[0] == "+" and cards:
            cards[-1] += " " + line[1:]
        elif line.split()[0] == ".end":
            break
        else:
            cards.append(line)
    out, scope = [], []
    for line in cards:
        card = _card(line) if line.strip("+ ") else ""
        if not card:
            continue
        out.append("/".join(scope) + "|" + card if scope else card)
        if card.startswith(".subckt "):
            scope.append(card.split()[1])
        elif card.startswith(".ends") and scope:
            scope.pop()
    return "\n".join(sorted(out))


def identity(netlist: str | None) -> str | None:
    """Key of a netlist: `file:` and the lower-cased file name for a one-line path,
    `deck:` and a digest of the canonical deck otherwise; None if null or blank."""
    if netlist is None:
        return None
    text = netlist.replace("\r\n", "\n").replace("\r", "\n").rstrip()
    if not text.strip():
        return None
    if "\n" not in text:
        return "file:" + re.split(r"[\\/]", text.strip())[-1].lower()
    return "deck:" + hashlib.md5(canonical(text).encode()).hexdigest()
