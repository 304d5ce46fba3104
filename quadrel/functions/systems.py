"""Projected systems by EPSG code, on WGS84 or an ellipsoid that is the same to a millimetre.

A code is known if its datum's usual shift from WGS84 is null (ETRS89, NAD83, GDA94,
GDA2020, SIRGAS 2000, CGCS2000, JGD, Korea 2000, NZGD2000) and its method is below. The
formulas are written once, over a namespace of functions, for columns and for numpy arrays.
A point that a system cannot show (the other pole) is infinite or NaN, not an error.
"""

from __future__ import annotations

import math
from functools import cache
from types import SimpleNamespace
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrel.functions.ellipsoid import A_AXIS, ALPHA, BETA, DELTA, GAMMA, RECTIFYING
from quadrel.functions.ellipsoid import E2 as ECC

COLUMNS = SimpleNamespace(
    sin=F.sin, cos=F.cos, sinh=F.sinh, cosh=F.cosh, asin=F.asin, atan=F.atan, atan2=F.atan2, atanh=F.atanh, exp=F.exp, log=F.log, sqrt=F.sqrt, hypot=F.hypot, floor=F.floor,
    radians=F.radians, degrees=F.degrees, most=lambda a, x: F.greatest(a, F.lit(x)), least=lambda a, x: F.least(a, F.lit(x)),
    number=lambda v: v if isinstance(v, Column) else F.lit(float(v)),
)
ARRAYS = SimpleNamespace(
    sin=np.sin, cos=np.cos, sinh=np.sinh, cosh=np.cosh, asin=np.arcsin, atan=np.arctan, atan2=np.arctan2, atanh=np.arctanh, exp=np.exp, log=np.log, sqrt=np.sqrt, hypot=np.hypot, floor=np.floor,
    radians=np.radians, degrees=np.degrees, most=np.maximum, least=np.minimum, number=float,
)


class System(NamedTuple):
    """A method and its numbers; lengths but those of fe and fn are in half axes."""

    name: str
    method: str
    lon0: float = 0.0
    n: float = 0.0  # the cone, or the authalic latitude of the centre
    c: float = 0.0  # the scale of the radius, or the stretch of the centre
    r0: float = 0.0  # radius or northing of the origin
    k: float = 1.0
    fe: float = 0.0
    fn: float = 0.0


# ---------------------------------------------------------------- latitudes


def _psi(m, phi):
    """Isometric latitude."""
    s = m.sin(phi)
    return m.atanh(s) - ECC * m.atanh(ECC * s)


def _q(m, phi):
    """The area's measure of a latitude, 0 at the equator."""
    s = m.sin(phi)
    return (1 - ECC**2) * (s / (1 - ECC**2 * s * s) + m.atanh(ECC * s) / ECC)


def _series(m, x, terms: list[float]):
    return x + sum((t * m.sin(2.0 * j * x) for j, t in enumerate(terms[1:], 2)), terms[0] * m.sin(2.0 * x))


def _of_psi(m, psi):
    return _series(m, m.atan(m.sinh(psi)), DELTA)


def _of_q(m, q):
    return _series(m, m.asin(m.most(m.least(q / Q_POLE, 1.0), -1.0)), GAMMA)


def _parallel(lat: float) -> float:
    """Radius of a parallel."""
    s = math.sin(math.radians(lat))
    return math.sqrt((1 - s * s) / (1 - ECC**2 * s * s))


Q_POLE = float(_q(ARRAYS, math.pi / 2))
R_AUTHALIC = math.sqrt(Q_POLE / 2)


# ---------------------------------------------------------------- methods


def forward(m, lng, lat, s):
    """Coordinates in a system (whose numbers may be columns) of a point in degrees."""
    s = _numbers(m, s)
    phi, d = m.radians(lat), lng - s.lon0
    lam = m.radians(d - 360.0 * m.floor((d + 180.0) / 360.0))
    x, y = _FORWARD[s.method](m, lam, phi, s)
    return s.fe + A_AXIS * x, s.fn + A_AXIS * y


def inverse(m, x, y, s):
    """Longitude and latitude in degrees of a point in a system."""
    s = _numbers(m, s)
    lam, phi = _INVERSE[s.method](m, (x - s.fe) / A_AXIS, (y - s.fn) / A_AXIS, s)
    d = s.lon0 + m.degrees(lam)
    # A zone's image goes on beyond 180 degrees; what goes around the earth does not.
    return (d if s.method == "tm" else d - 360.0 * m.floor((d + 180.0) / 360.0)), m.degrees(phi)


def _numbers(m, s: System) -> System:
    return System(s.name, s.method, *map(m.number, s[2:]))


def _tm(m, lam, phi, s):
    t = m.sinh(_psi(m, phi))
    xi, eta = m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(1 + t * t))
    east = sum((a * m.cos(2.0 * j * xi) * m.sinh(2.0 * j * eta) for j, a in enumerate(ALPHA, 1)), eta)
    north = sum((a * m.sin(2.0 * j * xi) * m.cosh(2.0 * j * eta) for j, a in enumerate(ALPHA, 1)), xi)
    scale = s.k * (RECTIFYING / A_AXIS)
    return scale * east, scale * north - s.r0


def _tm_back(m, x, y, s):
    scale = s.k * (RECTIFYING / A_AXIS)
    eta, xi = x / scale, (y + s.r0) / scale
    eta1 = sum((-b * m.cos(2.0 * j * xi) * m.sinh(2.0 * j * eta) for j, b in enumerate(BETA, 1)), eta)
    xi1 = sum((-b * m.sin(2.0 * j * xi) * m.cosh(2.0 * j * eta) for j, b in enumerate(BETA, 1)), xi)
    return m.atan2(m.sinh(eta1), m.cos(xi1)), _series(m, m.asin(m.sin(xi1) / m.cosh(eta1)), DELTA)


def _merc(m, lam, phi, s):
    return s.k * lam, s.k * _psi(m, phi)


def _merc_back(m, x, y, s):
    return x / s.k, _of_psi(m, y / s.k)


def _cylinder(m, lam, phi, s):
    return s.k * lam, _q(m, phi) / (2.0 * s.k)


def _cylinder_back(m, x, y, s):
    return x / s.k, _of_q(m, 2.0 * s.k * y)


def _cone(m, lam, r, s):
    return r * m.sin(s.n * lam), s.r0 - r * m.cos(s.n * lam)


def _cone_back(m, x, y, s):
    """Angle at the apex over n, and the radius over the cone's sign."""
    up, side = (s.r0 - y) * s.n, x * s.n  # turned by the sign of n
    return m.atan2(side, up) / s.n, m.hypot(x, s.r0 - y)


def _conformal(m, lam, phi, s):
    return _cone(m, lam, s.c * m.exp(-1.0 * s.n * _psi(m, phi)), s)


def _conformal_back(m, x, y, s):
    lam, r = _cone_back(m, x, y, s)
    sign = s.n / m.sqrt(s.n * s.n)
    return lam, _of_psi(m, -1.0 * m.log(m.most(r * sign / s.c, 1e-300)) / s.n)


def _equal_area(m, lam, phi, s):
    return _cone(m, lam, m.sqrt(m.most(s.c - s.n * _q(m, phi), 0.0)) / s.n, s)


def _equal_area_back(m, x, y, s):
    lam, r = _cone_back(m, x, y, s)
    return lam, _of_q(m, (s.c - s.n * s.n * r * r) / s.n)


def _azimuthal(m, lam, phi, s):
    b = m.asin(m.most(m.least(_q(m, phi) / Q_POLE, 1.0), -1.0))
    r = R_AUTHALIC * m.sqrt(2.0 / (1 + m.sin(b) * m.sin(s.n) + m.cos(b) * m.cos(s.n) * m.cos(lam)))
    return r * s.c * m.cos(b) * m.sin(lam), r / s.c * (m.sin(b) * m.cos(s.n) - m.cos(b) * m.sin(s.n) * m.cos(lam))


def _azimuthal_back(m, x, y, s):
    u, v = x / s.c, y * s.c
    r = m.most(m.hypot(u, v), 1e-300)
    arc = 2.0 * m.asin(m.least(r / (2 * R_AUTHALIC), 1.0))
    b = m.asin(m.most(m.least(m.cos(arc) * m.sin(s.n) + v * m.sin(arc) * m.cos(s.n) / r, 1.0), -1.0))
    return m.atan2(u * m.sin(arc), r * m.cos(s.n) * m.cos(arc) - v * m.sin(s.n) * m.sin(arc)), _series(m, b, GAMMA)


_FORWARD = {"tm": _tm, "merc": _merc, "cylinder": _cylinder, "conformal": _conformal, "equal_area": _equal_area, "azimuthal": _azimuthal}
_INVERSE = {"tm": _tm_back, "merc": _merc_back, "cylinder": _cylinder_back, "conformal": _conformal_back, "equal_area": _equal_area_back, "azimuthal": _azimuthal_back}
METHODS = list(_FORWARD)


# ---------------------------------------------------------------- makers


def transverse(name: str, lon0: float, lat0: float = 0.0, k: float = 0.9996, fe: float = 500000.0, fn: float = 0.0) -> System:
    flat = System(name, "tm", k=k)
    return flat._replace(lon0=lon0, r0=float(_tm(ARRAYS, 0.0, math.radians(lat0), flat)[1]), fe=fe, fn=fn)


def lambert(name: str, lon0: float, lat0: float, lat1: float, lat2: float, fe: float = 0.0, fn: float = 0.0) -> System:
    """Conformal cone with two standard parallels."""
    p0, p1, p2 = (float(_psi(ARRAYS, math.radians(v))) for v in (lat0, lat1, lat2))
    n = math.log(_parallel(lat1) / _parallel(lat2)) / (p2 - p1)
    c = _parallel(lat1) * math.exp(n * p1) / n
    return System(name, "conformal", lon0, n, c, c * math.exp(-n * p0), 1.0, fe, fn)


def stereographic(name: str, lon0: float, true: float | None, south: bool, k: float = 1.0, fe: float = 0.0, fn: float = 0.0) -> System:
    """Polar, true at a latitude or scaled at the pole: the conformal cone that is flat."""
    n = -1.0 if south else 1.0
    if true is None:
        c = n * 2 * k / math.sqrt((1 + ECC) ** (1 + ECC) * (1 - ECC) ** (1 - ECC))
    else:
        c = _parallel(true) * math.exp(n * float(_psi(ARRAYS, math.radians(true)))) / n
    return System(name, "conformal", lon0, n, c, 0.0, 1.0, fe, fn)


def albers(name: str, lon0: float, lat0: float, lat1: float, lat2: float, fe: float = 0.0, fn: float = 0.0) -> System:
    q0, q1, q2 = (float(_q(ARRAYS, math.radians(v))) for v in (lat0, lat1, lat2))
    n = (_parallel(lat1) ** 2 - _parallel(lat2) ** 2) / (q2 - q1)
    c = _parallel(lat1) ** 2 + n * q1
    return System(name, "equal_area", lon0, n, c, math.sqrt(c - n * q0) / n, 1.0, fe, fn)


def azimuthal(name: str, lon0: float, lat0: float, fe: float = 0.0, fn: float = 0.0) -> System:
    """Equal areas around a point; around a pole, the equal-area cone that is flat."""
    if abs(lat0) == 90:
        return System(name, "equal_area", lon0, math.copysign(1.0, lat0), Q_POLE, 0.0, 1.0, fe, fn)
    b = math.asin(float(_q(ARRAYS, math.radians(lat0))) / Q_POLE)
    return System(name, "azimuthal", lon0, b, _parallel(lat0) / (R_AUTHALIC * math.cos(b)), 0.0, 1.0, fe, fn)


# ---------------------------------------------------------------- codes

# Systems in degrees.
GEOGRAPHIC = {
    4167: "NZGD2000", 4171: "RGF93 v1", 4258: "ETRS89", 4269: "NAD83", 4283: "GDA94", 4326: "WGS 84", 4490: "CGCS2000", 4612: "JGD2000",
    4617: "NAD83(CSRS)", 4674: "SIRGAS 2000", 4737: "Korea 2000", 6318: "NAD83(2011)", 6668: "JGD2011", 7844: "GDA2020",
}

# Runs of UTM zones. First code, first zone, zones, hemisphere, name before the zone.
_ZONES = [
    (2955, 11, 3, "N", "NAD83(CSRS) / UTM zone "), (2958, 17, 5, "N", "NAD83(CSRS) / UTM zone "), (3097, 51, 5, "N", "JGD2000 / UTM zone "),
    (3154, 7, 4, "N", "NAD83(CSRS) / UTM zone "), (3158, 14, 3, "N", "NAD83(CSRS) / UTM zone "), (6330, 1, 19, "N", "NAD83(2011) / UTM zone "),
    (6688, 51, 5, "N", "JGD2011 / UTM zone "), (7846, 46, 14, "S", "GDA2020 / MGA zone "), (25828, 28, 11, "N", "ETRS89 / UTM zone "),
    (26901, 1, 23, "N", "NAD83 / UTM zone "), (28348, 48, 11, "S", "GDA94 / MGA zone "), (31965, 11, 12, "N", "SIRGAS 2000 / UTM zone "),
    (31977, 17, 9, "S", "SIRGAS 2000 / UTM zone "), (32601, 1, 60, "N", "WGS 84 / UTM zone "), (32701, 1, 60, "S", "WGS 84 / UTM zone "),
]

# Origins (latitude, longitude in degrees and minutes) of the Japanese plane systems I to XIX.
_JAPAN = [
    (33, 129, 30), (33, 131, 0), (36, 132, 10), (33, 133, 30), (36, 134, 20), (36, 136, 0), (36, 137, 10), (36, 138, 30), (36, 139, 50), (40, 140, 50),
    (44, 140, 15), (44, 142, 15), (44, 144, 15), (26, 142, 0), (26, 127, 30), (26, 124, 0), (26, 131, 0), (20, 136, 0), (26, 154, 0),
]
_ROMAN = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX".split()


def _single() -> dict[int, System]:
    # The published parameters of single systems.
    return {
        2154: lambert("RGF93 v1 / Lambert-93", 3, 46.5, 49, 44, 700000, 6600000),
        2157: transverse("IRENET95 / Irish Transverse Mercator", -8, 53.5, 0.99982, 600000, 750000),
        2180: transverse("ETRF2000-PL / CS92", 19, 0, 0.9993, 500000, -5300000),
        2193: transverse("NZGD2000 / New Zealand Transverse Mercator 2000", 173, 0, 0.9996, 1600000, 10000000),
        3005: albers("NAD83 / BC Albers", -126, 45, 50, 58.5, 1000000, 0),
        3006: transverse("SWEREF99 TM", 15),
        3031: stereographic("WGS 84 / Antarctic Polar Stereographic", 0, -71, True),
        3032: stereographic("WGS 84 / Australian Antarctic Polar Stereographic", 70, -71, True, 1.0, 6000000, 6000000),
        3034: lambert("ETRS89-extended / LCC Europe", 10, 52, 35, 65, 4000000, 2800000),
        3035: azimuthal("ETRS89-extended / LAEA Europe", 10, 52, 4321000, 3210000),
        3059: transverse("LKS-92 / Latvia TM", 24, 0, 0.9996, 500000, -6000000),
        3067: transverse("ETRS89 / TM35FIN(E,N)", 27),
        3083: albers("NAD83 / Texas Centric Albers Equal Area", -100, 18, 27.5, 35, 1500000, 6000000),
        3112: lambert("GDA94 / Geoscience Australia Lambert", 134, 0, -18, -36),
        3301: lambert("Estonian Coordinate System of 1997", 24, 57.51755393055556, 59 + 1 / 3, 58, 500000, 6375000),
        3310: albers("NAD83 / California Albers", -120, 0, 34, 40.5, 0, -4000000),
        3338: albers("NAD83 / Alaska Albers", -154, 50, 55, 65),
        3346: transverse("LKS94 / Lithuania TM", 24, 0, 0.9998),
        3347: lambert("NAD83 / Statistics Canada Lambert", -(91 + 52 / 60), 63.390675, 49, 77, 6200000, 3000000),
        3395: System("WGS 84 / World Mercator", "merc"),
        3413: stereographic("WGS 84 / NSIDC Sea Ice Polar Stereographic North", -45, 70, False),
        3577: albers("GDA94 / Australian Albers", 132, 0, -18, -36),
        3765: transverse("HTRS96 / Croatia TM", 16.5, 0, 0.9999),
        3794: transverse("Slovenia 1996 / Slovene National Grid", 15, 0, 0.9999, 500000, -5000000),
        3812: lambert("ETRS89 / Belgian Lambert 2008", 4.359215833333333, 50.797815, 49 + 5 / 6, 51 + 1 / 6, 649328, 665262),
        3832: System("WGS 84 / PDC Mercator", "merc", 150.0),
        3976: stereographic("WGS 84 / NSIDC Sea Ice Polar Stereographic South", 0, -70, True),
        3978: lambert("NAD83 / Canada Atlas Lambert", -95, 49, 49, 77),
        3994: System("WGS 84 / Mercator 41", "merc", 100.0, k=_parallel(41)),
        3995: stereographic("WGS 84 / Arctic Polar Stereographic", 0, 71, False),
        3996: stereographic("WGS 84 / IBCAO Polar Stereographic", 0, 75, False),
        5041: stereographic("WGS 84 / UPS North (E,N)", 0, None, False, 0.994, 2000000, 2000000),
        5042: stereographic("WGS 84 / UPS South (E,N)", 0, None, True, 0.994, 2000000, 2000000),
        5070: albers("NAD83 / Conus Albers", -96, 23, 29.5, 45.5),
        5179: transverse("Korea 2000 / Unified CS", 127.5, 38, 0.9996, 1000000, 2000000),
        6350: albers("NAD83(2011) / Conus Albers", -96, 23, 29.5, 45.5),
        6931: azimuthal("WGS 84 / NSIDC EASE-Grid 2.0 North", 0, 90),
        6932: azimuthal("WGS 84 / NSIDC EASE-Grid 2.0 South", 0, -90),
        6933: System("WGS 84 / NSIDC EASE-Grid 2.0 Global", "cylinder", k=_parallel(30)),
        32661: stereographic("WGS 84 / UPS North (N,E)", 0, None, False, 0.994, 2000000, 2000000),
        32761: stereographic("WGS 84 / UPS South (N,E)", 0, None, True, 0.994, 2000000, 2000000),
    }


@cache
def known() -> dict[int, System]:
    """All projected systems but Web Mercator, by code."""
    out = _single()
    for first, zone, count, side, name in _ZONES:
        for i in range(count):
            end = side if "UTM" in name else ""
            out[first + i] = transverse(f"{name}{zone + i}{end}", (zone + i) * 6 - 183.0, fn=10000000.0 if side == "S" else 0.0)
    for step, first, zone, kind in ((6, 4491, 13, ""), (3, 4513, 25, "3-degree ")):
        count = 60 // step + 1  # central meridians 75 to 135
        for i in range(count):
            lon0, title = 75.0 + step * i, f"CGCS2000 / {kind}Gauss-Kruger "
            out[first + i] = transverse(f"{title}zone {zone + i}", lon0, 0, 1.0, (zone + i) * 1e6 + 500000)
            out[first + count + i] = transverse(f"{title}CM {lon0:.0f}E", lon0, 0, 1.0)
    for i, (lat0, degrees, minutes) in enumerate(_JAPAN):
        for first, datum in ((2443, "JGD2000"), (6669, "JGD2011")):
            out[first + i] = transverse(f"{datum} / Japan Plane Rectangular CS {_ROMAN[i]}", degrees + minutes / 60, lat0, 0.9999, 0.0)
    for i, belt in enumerate(("West Belt", "Central Belt", "East Belt", "East Sea Belt")):
        out[5185 + i] = transverse(f"Korea 2000 / {belt} 2010", 125.0 + 2 * i, 38, 1.0, 200000, 600000)
    for i in range(9):
        out[3942 + i] = lambert(f"RGF93 v1 / CC{42 + i}", 3, 42 + i, 41.25 + i, 42.75 + i, 1700000, 1200000 + 1e6 * i)
    for i, lon0 in enumerate((180.0, -150.0, -100.0, -40.0, 10.0, 90.0)):
        region = ("Bering Sea", "Alaska", "Canada", "Atlantic", "Europe", "Russia")[i]
        out[3571 + i] = azimuthal(f"WGS 84 / North Pole LAEA {region}", lon0, 90)
    return out


@cache
def names() -> list[tuple[int, str, int]]:
    """(code, name, ord) of all known systems, for `crs.name_table`."""
    every = GEOGRAPHIC | {3857: "WGS 84 / Pseudo-Mercator"} | {code: s.name for code, s in known().items()}
    return [(code, name, 0) for code, name in sorted(every.items())]
