"""Shape kernels that need a loop over points: numpy inside Arrow-batched functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

XY = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def _as_array(pts) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in pts], dtype=float).reshape(-1, 2)


def keep_indices(pts: np.ndarray, tol: float) -> np.ndarray:
    """Points a Douglas-Peucker pass keeps: ends, and the farthest point of any span that strays too far."""
    n = len(pts)
    keep = np.zeros(n, dtype=bool)
    if n == 0:
        return keep
    keep[[0, -1]] = True
    spans = [(0, n - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        inner, d = pts[a + 1:b] - pts[a], pts[b] - pts[a]
        length = float(np.hypot(*d))
        dist = np.hypot(inner[:, 0], inner[:, 1]) if length == 0 else np.abs(d[0] * inner[:, 1] - d[1] * inner[:, 0]) / length
        far = int(dist.argmax())
        if dist[far] > tol:
            mid = a + 1 + far
            keep[mid] = True
            spans += [(a, mid), (mid, b)]
    return keep


def simplify_line(pts: Column, tolerance: float) -> Column:
    """Line with points nearer than `tolerance` to their span removed."""
    @F.pandas_udf(XY)
    def run(col: pd.Series) -> pd.Series:
        out = []
        for row in col:
            arr = _as_array(row)
            out.append([{"x": x, "y": y} for x, y in arr[keep_indices(arr, tolerance)]])
        return pd.Series(out)

    return run(pts)


def simplify_to_budget(pts: Column, budget: int, tries: int = 12) -> Column:
    """Simplify with a tolerance that doubles until at most `budget` points are left; null if it never does."""
    @F.pandas_udf(XY)
    def run(col: pd.Series) -> pd.Series:
        out = []
        for row in col:
            arr = _as_array(row)
            if len(arr) > budget:
                tol = float(np.ptp(arr, axis=0).max()) / 100000
                for _ in range(tries):
                    arr = arr[keep_indices(arr, tol)]
                    if len(arr) <= budget:
                        break
                    tol *= 2
            out.append([{"x": x, "y": y} for x, y in arr] if len(arr) <= budget else None)
        return pd.Series(out)

    return run(pts)


def hull(pts: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise."""
    pts = np.unique(pts, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        chain: list[np.ndarray] = []
        for p in seq:
            while len(chain) > 1:
                u, v = chain[-1] - chain[-2], p - chain[-2]
                if u[0] * v[1] - u[1] * v[0] > 0:
                    break
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def smallest_rectangle(pts: np.ndarray) -> tuple[float, float, float]:
    """(short side, long side, angle of the long side from the nearest axis in degrees)."""
    h = hull(pts)
    if len(h) < 2:
        return 0.0, 0.0, 0.0
    step = np.roll(h, -1, axis=0) - h
    theta = np.unique(np.round(np.arctan2(step[:, 1], step[:, 0]) % (np.pi / 2), 12))
    c, s = np.cos(theta)[:, None], np.sin(theta)[:, None]
    u, v = c * h[:, 0] + s * h[:, 1], -s * h[:, 0] + c * h[:, 1]
    du, dv = np.ptp(u, axis=1), np.ptp(v, axis=1)
    best = int(np.round(du * dv, 9).argmin())
    a, b = float(du[best]), float(dv[best])
    along = np.degrees(theta[best]) + (0 if a >= b else 90)
    off = abs(along) % 90.0
    return min(a, b), max(a, b), float(min(off, 90.0 - off))


def min_rotated_rect(pts: Column) -> Column:
    """Oriented box of a ring: short and long side, and its angle to the grid, 0..45."""
    @F.pandas_udf("short_side double, long_side double, angle double")
    def run(col: pd.Series) -> pd.DataFrame:
        rows = [smallest_rectangle(_as_array(r)) for r in col]
        return pd.DataFrame(rows, columns=["short_side", "long_side", "angle"])

    return run(pts)


def grid_path(pts: Column) -> Column:
    """A polyline as unit steps along tile corners.

    A point belongs to its nearest corner. Along a segment the corner changes where the
    segment crosses a line half-way between two corners; the crossings of either axis,
    in the order they are met (x first at a tie), are the steps. A single point gives its
    corner, an empty or null list null.
    """
    def corner(v):
        return F.floor(v + 0.5).cast("int")

    def crossings(a, b, axis):
        first, last = corner(a), corner(b)
        n = F.abs(last - first)
        turn = F.signum((last - first).cast("double"))
        at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda k: F.struct(((first + turn * (k - 0.5) - a) / (b - a)).alias("t"), F.lit(axis).alias("axis"), k.alias("k")))

    def steps(a, b):
        met = F.array_sort(F.concat(crossings(a["x"], b["x"], 0), crossings(a["y"], b["y"], 1)))
        # At place m of the order, the axis that moves has made k steps and the other m + 1 - k.
        return F.transform(met, lambda s, m: F.struct(
            (corner(a["x"]) + F.signum((corner(b["x"]) - corner(a["x"])).cast("double")) * F.when(s["axis"] == 0, s["k"]).otherwise(m + 1 - s["k"])).cast("int").alias("x"),
            (corner(a["y"]) + F.signum((corner(b["y"]) - corner(a["y"])).cast("double")) * F.when(s["axis"] == 1, s["k"]).otherwise(m + 1 - s["k"])).cast("int").alias("y")))

    origin = F.transform(F.slice(pts, 1, 1), lambda p: F.struct(corner(p["x"]).alias("x"), corner(p["y"]).alias("y")))
    rest = F.transform(F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))), lambda q, i: steps(F.get(pts, i), q))
    return F.when(F.size(pts) > 0, F.concat(origin, F.flatten(rest)))
