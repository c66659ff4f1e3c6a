"""Path geometry: a state machine over path commands, one handler per command family."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

_PIECE = re.compile(r"([MmLlHhVvAaQqTtCcSsZz])|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")
#: Numbers that one repetition of a command takes.
ARITY = {"M": 2, "L": 2, "H": 1, "V": 1, "A": 7, "C": 6, "S": 4, "Q": 4, "T": 2, "Z": 0}


@dataclass
class Segment:
    type: str
    start: tuple[float, float]
    end: tuple[float, float]
    length: float
    extra: dict[str, float] | None = None


def commands(d: str) -> list[tuple[str, list[float]]]:
    out: list[tuple[str, list[float]]] = []
    for m in _PIECE.finditer(d):
        if m[1]:
            out.append((m[1], []))
        elif out:
            out[-1][1].append(float(m[2]))
    return out


def arc_length(chord: float, rx: float, ry: float) -> float:
    """Length of an arc over a chord at the mean radius; the chord itself without a radius."""
    r = (abs(rx) + abs(ry)) / 2
    return chord if r < 1e-9 else 2 * r * math.asin(min(chord / (2 * r), 1.0))


@dataclass
class Pen:
    """Current point, start of the sub-path, and the segments drawn so far."""

    at: tuple[float, float] = (0.0, 0.0)
    begun: tuple[float, float] = (0.0, 0.0)
    drawn: list[Segment] = field(default_factory=list)

    def to(self, kind: str, end: tuple[float, float], length: float | None = None, extra: dict[str, float] | None = None) -> None:
        self.drawn.append(Segment(kind, self.at, end, math.dist(self.at, end) if length is None else length, extra))
        self.at = end


def path_segments(d: str, compat: bool = False) -> list[Segment]:
    """Segments of a path. Curves count as their chord. ``compat`` keeps two old habits: further
    pairs after a relative move are ignored, and smooth quadratics are read four numbers at a time."""
    pen = Pen()
    for letter, numbers in commands(d or ""):
        upper, relative = letter.upper(), letter.islower()
        if upper == "Z":
            if pen.at != pen.begun:
                pen.to("close", pen.begun)
            pen.at = pen.begun
            continue
        step = 4 if compat and upper == "T" else ARITY[upper]
        if compat and upper == "T" and len(numbers) % 4:
            raise ValueError("a smooth quadratic without four numbers")
        for k in range(0, len(numbers) - step + 1, step):
            group = numbers[k : k + step]
            base = pen.at if relative else (0.0, 0.0)
            if upper == "H":
                end = (base[0] + group[0], pen.at[1])
            elif upper == "V":
                end = (pen.at[0], base[1] + group[0])
            else:
                end = (base[0] + group[-2], base[1] + group[-1])
            if upper == "M" and k == 0:
                pen.at = pen.begun = end
            elif upper == "M":
                if not (compat and relative):
                    pen.to("line", end)
            elif upper == "A":
                rx, ry, turn, large, sweep = group[:5]
                extra = {"rx": rx, "ry": ry, "x_rotation": turn, "large_arc": large, "sweep": sweep}
                pen.to("arc", end, arc_length(math.dist(pen.at, end), rx, ry), extra)
            else:
                pen.to("line" if upper in "LHV" else "curve", end)
    return pen.drawn


def bounds(segments: list[Segment]) -> tuple[float, float, float, float] | None:
    points = [p for s in segments for p in (s.start, s.end)]
    if not points:
        return None
    xs, ys = zip(*points, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def dominant_type(segments: list[Segment]) -> str:
    """Most frequent type, on a tie the one drawn first."""
    counts: dict[str, int] = {}
    for s in segments:
        counts[s.type] = counts.get(s.type, 0) + 1
    return max(counts, key=lambda t: counts[t])
