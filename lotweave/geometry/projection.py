"""Transverse Mercator after Krüger's series to the third order in the third flattening, and which one a file is in."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np

# The ellipsoid GRS80.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101


@dataclass(frozen=True)
class Belt:
    """A transverse Mercator projection: origin in degrees, false origin in metres, scale, ellipsoid."""

    lon0: float
    lat0: float
    east: float
    north: float
    scale: float = 1.0
    semi_major: float = SEMI_MAJOR
    flattening: float = FLATTENING

    @cached_property
    def _n(self) -> float:
        return self.flattening / (2 - self.flattening)

    @cached_property
    def _radius(self) -> float:
        n = self._n
        return self.scale * self.semi_major / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @cached_property
    def _y0(self) -> float:
        return self._forward(self.lon0, self.lat0)[1]

    def _forward(self, lon, lat):
        n = self._n
        phi, lam = np.radians(lat), np.radians(np.asarray(lon) - self.lon0)
        k = 2 * np.sqrt(n) / (1 + n)
        t = np.sinh(np.arctanh(np.sin(phi)) - k * np.arctanh(k * np.sin(phi)))
        xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
        alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
        x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
        y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
        return self._radius * x, self._radius * y

    def to_metres(self, lon, lat):
        x, y = self._forward(lon, lat)
        return x + self.east, y - self._y0 + self.north

    def to_degrees(self, east, north):
        n = self._n
        xi, eta = (np.asarray(north) - self.north + self._y0) / self._radius, (np.asarray(east) - self.east) / self._radius
        beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
        delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
        xi, eta = (
            xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(beta, 1)),
            eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(beta, 1)),
        )
        chi = np.arcsin(np.sin(xi) / np.cosh(eta))
        phi = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(delta, 1))
        return self.lon0 + np.degrees(np.arctan2(np.sinh(eta), np.cos(xi))), np.degrees(phi)


# EPSG codes of the Korean systems on GRS80 (None: degrees), and the belt used if nothing else is said.
CODES = {
    "EPSG:4326": None,
    "EPSG:4737": None,
    "EPSG:5179": Belt(127.5, 38.0, 1000000.0, 2000000.0, 0.9996),
    "EPSG:5185": Belt(125.0, 38.0, 200000.0, 600000.0),
    "EPSG:5186": Belt(127.0, 38.0, 200000.0, 600000.0),
    "EPSG:5187": Belt(129.0, 38.0, 200000.0, 600000.0),
    "EPSG:5188": Belt(131.0, 38.0, 200000.0, 600000.0),
}
CENTRAL = CODES["EPSG:5186"]
to_metres, to_degrees = CENTRAL.to_metres, CENTRAL.to_degrees


def system(crs: str) -> Belt | None:
    """The belt that an EPSG code or the text of a .prj file names; None stands for degrees.

    Ellipsoids other than GRS80 and WGS84 need a shift of datum, which isn't built: they raise an error, as unknown codes do.
    """
    crs = crs.strip().lstrip("\ufeff")
    if crs.upper() in CODES:
        return CODES[crs.upper()]
    body = re.search(r'SPHEROID\["[^"]*",\s*([\d.]+),\s*([\d.]+)', crs, re.I)
    if body is None or abs(float(body[1]) - SEMI_MAJOR) > 0.5:
        raise ValueError(f"unknown coordinate system: {crs[:80]}")
    if re.match(r"GEOG", crs, re.I):
        return None
    if not re.search(r'PROJECTION\["Transverse_Mercator"', crs, re.I):
        raise ValueError(f"unknown projection: {crs[:80]}")
    said = {k.lower(): float(v) for k, v in re.findall(r'PARAMETER\["(\w+)",\s*([-+\d.eE]+)', crs, re.I)}
    return Belt(said["central_meridian"], said.get("latitude_of_origin", 0.0), said.get("false_easting", 0.0), said.get("false_northing", 0.0), said.get("scale_factor", 1.0), float(body[1]), 1 / float(body[2]))


def move(points: np.ndarray, source: str, target: str) -> np.ndarray:
    """Points of one system in another one."""
    a, b = system(source), system(target)
    if a == b:
        return points
    x, y = points[:, 0], points[:, 1]
    if a is not None:
        x, y = a.to_degrees(x, y)
    if b is not None:
        x, y = b.to_metres(x, y)
    return np.stack([x, y], 1)
