"""Projections of numpy arrays: what `crs` does for columns, for the code that works on arrays.

A system is given by its code or, where parameters define it, as such.
"""

from __future__ import annotations

import numpy as np

from quadrel.functions import grid, systems


def forward(lng: np.ndarray, lat: np.ndarray, code: int | systems.System) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates in a known CRS; ValueError for another."""
    if code in systems.GEOGRAPHIC:
        return lng, lat
    if code == 3857:
        phi = np.radians(np.clip(lat, -grid.LAT_EXTENT, grid.LAT_EXTENT))
        return lng * grid.HALF / 180, grid.RADIUS * np.log(np.tan(np.pi / 4 + phi / 2))
    system = _system(code)
    with np.errstate(divide="ignore", invalid="ignore"):  # the poles
        return systems.forward(systems.ARRAYS, lng, lat, system)


def inverse(x: np.ndarray, y: np.ndarray, code: int | systems.System) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude of coordinates in a known CRS; ValueError for another."""
    if code in systems.GEOGRAPHIC:
        return x, y
    if code == 3857:
        return x * 180 / grid.HALF, np.degrees(2 * (np.arctan(np.exp(y / grid.RADIUS)) - np.pi / 4))
    system = _system(code)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return systems.inverse(systems.ARRAYS, x, y, system)


def _system(code: int | systems.System) -> systems.System:
    if isinstance(code, systems.System):
        return code
    if code not in systems.known():
        raise ValueError(f"unknown CRS {code}")
    return systems.known()[code]


def corners(gt: list[float], width: int, height: int) -> tuple[float, float, float, float]:
    """min x, min y, max x, max y of a raster (north up; rotation is not used)."""
    x0, y0 = gt[0], gt[3]
    x1, y1 = x0 + gt[1] * width, y0 + gt[5] * height
    return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)


def guess(box: tuple[float, float, float, float]) -> int | None:
    """4326 or 3857 by the range of the corners."""
    xs, every = (abs(box[0]), abs(box[2])), [abs(v) for v in box]
    if max(xs) <= 180 and max(every[1], every[3]) <= 90:
        return 4326
    return 3857 if min(xs) > 180 and max(every) <= 20037508.34 else None


def declared(code: int | None, tm: list[float] | None) -> int | systems.System | None:
    """A raster's system by its code, else by its transverse Mercator parameters (lon0, lat0, k, fe, fn)."""
    return code or (systems.transverse("", *tm) if tm else None)


def extent(gt: list[float] | None, width: int, height: int, code: int | systems.System | None) -> list[float] | None:
    """[west, south, east, north] of a raster's corners, by the declared code if it is known, else by the guess."""
    if not gt:
        return None
    box = corners(gt, width, height)
    if not (isinstance(code, systems.System) or code == 3857 or code in systems.GEOGRAPHIC or code in systems.known()):
        code = guess(box)
    if code is None:
        return None
    lng, lat = inverse(np.array([box[0], box[2], box[0], box[2]]), np.array([box[1], box[1], box[3], box[3]]), code)
    out = [float(v) for v in (lng.min(), lat.min(), lng.max(), lat.max())]
    return out if np.isfinite(out).all() else None
