"""UTM projection to a rotated tile grid, as column expressions.

Transverse Mercator by the Krueger series on WGS84, to the third order, which
is well under a millimetre inside a zone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as V
from .geo import let

# The WGS84 ellipsoid and the UTM frame.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500000.0, 10000000.0

_N = FLATTENING / (2 - FLATTENING)
_ECC = 2 * math.sqrt(_N) / (1 + _N)
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240]
_BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480]
_DELTA = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15]


@dataclass(frozen=True)
class Grid:
    """One projected tile grid, closed over as literals."""

    zone: int
    south: bool
    min_x: float
    min_y: float
    width: int
    height: int
    metres_per_tile: float = 1.0
    rotation: float = 0.0
    rot_x: float = 0.0
    rot_y: float = 0.0

    @property
    def epsg(self) -> int:
        return (32700 if self.south else 32600) + self.zone

    def window(self, x0: int, y0: int, w: int, h: int) -> "Grid":
        """A rectangle of this grid that turns about the same centre."""
        north = self.min_y + self.height * self.metres_per_tile
        return Grid(self.zone, self.south, self.min_x + x0 * self.metres_per_tile,
                    north - (y0 + h) * self.metres_per_tile, w, h, self.metres_per_tile,
                    self.rotation, self.rot_x, self.rot_y)


def _sinh(x):
    return (F.exp(x) - F.exp(-x)) / 2.0


def _cosh(x):
    return (F.exp(x) + F.exp(-x)) / 2.0


def _atanh(x):
    return F.log((1.0 + x) / (1.0 - x)) / 2.0


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def to_utm(lat: Column, lon: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    lam = F.radians(lon - float(zone * 6 - 183))
    phi = F.sin(F.radians(lat))
    t = _sinh(_atanh(phi) - _ECC * _atanh(_ECC * phi))
    xi = F.atan2(t, F.cos(lam))
    eta = _atanh(F.sin(lam) / F.sqrt(1.0 + t * t))
    north, east = xi, eta
    for j, a in enumerate(_ALPHA, 1):
        north = north + a * F.sin(2.0 * j * xi) * _cosh(2.0 * j * eta)
        east = east + a * F.cos(2.0 * j * xi) * _sinh(2.0 * j * eta)
    k = SCALE * _RADIUS
    return FALSE_EASTING + k * east, (FALSE_NORTHING if south else 0.0) + k * north


def from_utm(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    k = SCALE * _RADIUS
    xi = (y - (FALSE_NORTHING if south else 0.0)) / k
    eta = (x - FALSE_EASTING) / k
    xi0, eta0 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi0 = xi0 - b * F.sin(2.0 * j * xi) * _cosh(2.0 * j * eta)
        eta0 = eta0 - b * F.cos(2.0 * j * xi) * _sinh(2.0 * j * eta)
    chi = F.asin(F.sin(xi0) / _cosh(eta0))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2.0 * j * chi)
    lam = F.atan2(_sinh(eta0), F.cos(xi0))
    return F.degrees(phi), F.degrees(lam) + float(zone * 6 - 183)


def _turn(x, y, grid: Grid, degrees: float):
    a = math.radians(degrees)
    dx, dy = x - grid.rot_x, y - grid.rot_y
    return (grid.rot_x + dx * math.cos(a) - dy * math.sin(a),
            grid.rot_y + dx * math.sin(a) + dy * math.cos(a))


def project_utm(lat: Column, lon: Column, grid: Grid) -> tuple[Column, Column]:
    """Tile coordinates; y grows south."""
    x, y = to_utm(lat, lon, grid.zone, grid.south)
    if grid.rotation:
        x, y = _turn(x, y, grid, grid.rotation)
    return (x - grid.min_x) / grid.metres_per_tile, grid.height - (y - grid.min_y) / grid.metres_per_tile


def project_point(lat: Column, lon: Column, grid: Grid) -> Column:
    """Tile coordinates as a struct (x, y), each step evaluated once; for use inside lambdas, where Spark shares no parts."""
    k = SCALE * _RADIUS

    def series(s):
        north, east = s["xi"], s["eta"]
        for j, a in enumerate(_ALPHA, 1):
            north = north + a * F.sin(2.0 * j * s["xi"]) * _cosh(2.0 * j * s["eta"])
            east = east + a * F.cos(2.0 * j * s["xi"]) * _sinh(2.0 * j * s["eta"])
        return F.struct((FALSE_EASTING + k * east).alias("x"), ((FALSE_NORTHING if grid.south else 0.0) + k * north).alias("y"))

    def tiles(p):
        x, y = _turn(p["x"], p["y"], grid, grid.rotation) if grid.rotation else (p["x"], p["y"])
        return F.struct(((x - grid.min_x) / grid.metres_per_tile).alias("x"), (grid.height - (y - grid.min_y) / grid.metres_per_tile).alias("y"))

    def steep(s):
        return let(s["c"] / F.sqrt(1.0 + s["t"] * s["t"]), lambda r: F.struct(F.atan2(s["t"], s["d"]).alias("xi"), _atanh(r).alias("eta")))

    def from_phi(phi):
        lam = F.radians(lon - float(grid.zone * 6 - 183))
        t = let(_atanh(phi) - _ECC * _atanh(_ECC * phi), _sinh)
        return let(F.struct(t.alias("t"), F.sin(lam).alias("c"), F.cos(lam).alias("d")), steep)

    return let(let(let(F.sin(F.radians(lat)), from_phi), series), tiles)


def unproject_utm(px: Column, py: Column, grid: Grid) -> tuple[Column, Column]:
    x = grid.min_x + px * grid.metres_per_tile
    y = grid.min_y + (grid.height - py) * grid.metres_per_tile
    if grid.rotation:
        x, y = _turn(x, y, grid, -grid.rotation)
    return from_utm(x, y, grid.zone, grid.south)


def build_grid(s: float, w: float, n: float, e: float, metres_per_tile: float = 1.0, rotation: float = 0.0) -> Grid:
    """The grid of a selection: whole cells around its projected corners.

    Four points on the driver; the same series in plain floats.
    """
    zone, south = int(((w + e) / 2 + 180) / 6) + 1, (s + n) / 2 < 0
    pts = [_utm_point(la, lo, zone, south) for la in (s, n) for lo in (w, e)]
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    cells_w = max(1, math.ceil((max(xs) - min(xs)) / metres_per_tile / V.CELL))
    cells_h = max(1, math.ceil((max(ys) - min(ys)) / metres_per_tile / V.CELL))
    tw, th = cells_w * V.CELL, cells_h * V.CELL
    cx, cy = (min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2
    return Grid(zone, south, cx - tw * metres_per_tile / 2, cy - th * metres_per_tile / 2, tw, th,
                metres_per_tile, rotation, cx, cy)


def cover_bbox(grid: Grid, margin: float = 50.0) -> tuple[Column, Column, Column, Column]:
    """South, west, north, east of a box that holds the grid at any rotation."""
    w, h = grid.width * grid.metres_per_tile, grid.height * grid.metres_per_tile
    cx, cy = grid.min_x + w / 2, grid.min_y + h / 2
    r = math.hypot(w, h) / 2 + margin
    corners = [from_utm(F.lit(cx + dx), F.lit(cy + dy), grid.zone, grid.south) for dx in (-r, r) for dy in (-r, r)]
    lats, lons = [c[0] for c in corners], [c[1] for c in corners]
    return F.least(*lats), F.least(*lons), F.greatest(*lats), F.greatest(*lons)


def _utm_point(lat: float, lon: float, zone: int, south: bool) -> tuple[float, float]:
    lam = math.radians(lon - (zone * 6 - 183))
    phi = math.sin(math.radians(lat))
    t = math.sinh(math.atanh(phi) - _ECC * math.atanh(_ECC * phi))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.hypot(1, t))
    north = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    east = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    k = SCALE * _RADIUS
    return FALSE_EASTING + k * east, (FALSE_NORTHING if south else 0.0) + k * north
