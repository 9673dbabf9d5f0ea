"""Scoring curves as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Break points of the scoring curves.
TILT = [(-20, 0), (-18, 5), (-15, 22), (-12, 45), (-9, 70), (-7, 90), (-5, 100), (-3, 95), (-2, 80), (-1, 65), (0, 50)]
HF_RATIO = [(-70, 0), (-60, 12), (-52, 28), (-45, 45), (-40, 58), (-35, 72), (-30, 83), (-25, 92), (-20, 100), (-10, 100)]
MID_SNR = [(6, 3), (10, 15), (13, 28), (16, 42), (19, 57), (22, 70), (25, 82), (28, 92), (32, 100), (40, 100)]
CREST = [(4, 0), (6, 10), (9, 30), (13, 75), (16, 95), (19, 100), (22, 100), (26, 85), (30, 60), (36, 40)]
FLAT_REL = [(1.0, 0.0), (2.0, 0.3), (3.0, 0.6), (5.0, 0.9), (8.0, 1.0)]
DUR_REL = [(0.3, 1.0), (0.55, 0.85), (0.75, 0.55), (0.95, 0.2), (1.2, 0.0)]
GROUP_WEIGHTS = {"tone": 0.35, "noise": 0.15, "dynamics": 0.5}
SOURCE_OFFSET = {"SBD": 0.0, "FM": 1.5, "MTX": 2.0, "AUD": -3.0}


def curve(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through the points, constant beyond them; null stays null."""
    out = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for (a, p), (b, q) in zip(points, points[1:]):
        out = out.when(x <= b, p + (x - a) * ((q - p) / (b - a)))
    return out.when(x.isNotNull(), F.lit(float(points[-1][1])))


def curve_sql(x: str, points: list[tuple[float, float]]) -> str:
    """The same as SQL."""
    parts = [f"WHEN {x} <= {points[0][0]} THEN {float(points[0][1])!r}"]
    parts += [f"WHEN {x} <= {b} THEN {p} + ({x} - ({a})) * CAST({(q - p) / (b - a)!r} AS DOUBLE)" for (a, p), (b, q) in zip(points, points[1:])]
    return f"CASE {' '.join(parts)} WHEN {x} IS NOT NULL THEN {float(points[-1][1])!r} END"


def geometric(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted geometric mean of what is known, values floored at 1."""
    total = sum((F.when(v.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, v in values.items()), F.lit(0.0))
    logs = sum((F.when(v.isNotNull(), weights[k] * F.log(F.greatest(v, F.lit(1.0)))).otherwise(0.0) for k, v in values.items()), F.lit(0.0))
    return F.when(total > 0, F.exp(logs / total))
