"""Converting quantities between units of size, rate and time."""

from __future__ import annotations

import re
from collections import deque

# Fixed values: (unit, smaller unit, how many of them).
CONVERSIONS = (
    ("R", "B", 100), ("KB", "B", 1000), ("MB", "KB", 1000), ("GB", "MB", 1000), ("TB", "GB", 1000),
    ("KiB", "B", 1024), ("MiB", "B", 1024**2), ("GiB", "B", 1024**3), ("TiB", "B", 1024**4),
    ("s", "ms", 1000), ("ms", "us", 1000), ("min", "s", 60),
    ("B", "b", 8), ("Kb", "b", 1000), ("Mb", "Kb", 1000), ("Gb", "Mb", 1000), ("Kib", "b", 1024), ("Mib", "b", 1024**2), ("Gib", "b", 1024**3), ("Tib", "b", 1024**4),
)

_EDGES: dict[str, dict[str, float]] = {}
for _big, _small, _n in CONVERSIONS:
    _EDGES.setdefault(_big, {})[_small] = float(_n)
    _EDGES.setdefault(_small, {})[_big] = 1.0 / _n

UNITS = sorted({*_EDGES, *(f"{u}ps" for u in _EDGES if u[-1] in "bB")}, key=len, reverse=True)
_QUANTITY = re.compile(rf"([0-9.]+)\s*({'|'.join(UNITS)})$")


def factor(source: str, target: str) -> float:
    """By what a quantity in ``source`` is multiplied to be in ``target``, over the fewest steps. A rate (…ps) converts to a rate. ValueError if there is no way."""
    if source.endswith("ps") and target.endswith("ps"):
        source, target = source[:-2], target[:-2]
    seen, queue = {source}, deque([(source, 1.0)])
    while queue:
        unit, f = queue.popleft()
        if unit == target:
            return f
        for to, by in _EDGES.get(unit, {}).items():
            if to not in seen:
                seen.add(to)
                queue.append((to, f * by))
    raise ValueError(f"no conversion from {source} to {target}")


def convert(quantity: float, source: str, target: str) -> float:
    return quantity * factor(source, target)


def parse(text: str) -> tuple[float, str] | None:
    """A quantity and its unit, as in ``10 MBps``; None if the text is no such thing."""
    m = _QUANTITY.match(text.strip())
    return (float(m[1]), m[2]) if m else None


def parse_and_convert(text: str, target: str) -> float | None:
    parsed = parse(text)
    return convert(*parsed, target) if parsed else None
