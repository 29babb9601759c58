"""WGS84 points and geodesic distances.

The inverse problem is solved in the form of Bessel's integrals: for an azimuth
at the more polar point both distance and longitude are integrals along the
auxiliary sphere, here by Gauss-Legendre quadrature; the longitude rises with
the azimuth in this arrangement (Karney, 2013), so a bracketing search finds it,
also near antipodes. Works on whole Arrow batches, once for each different pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from .registry import INTEGERS, URN, Operation, Result, Typed, fail, type_error

A, FLATTENING = 6378137.0, 1 / 298.257223563  # WGS84, fixed values
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)
_PARTS = 4  # of an arc, for the distance; the search needs one
_STEPS = 200


def _integrals(k2, lo, hi, parts):
    """Integrals over sigma of the distance and the longitude integrand, [lo, hi] in ``parts``."""
    distance, longitude = np.zeros_like(k2), np.zeros_like(k2)
    for part in range(parts):
        a, b = lo + (hi - lo) * part / parts, lo + (hi - lo) * (part + 1) / parts
        mid, half = (a + b) / 2, (b - a) / 2
        root = np.sqrt(1 + k2[..., None] * np.sin(mid[..., None] + half[..., None] * _NODES) ** 2)
        distance += half * (root @ _WEIGHTS)
        longitude += half * (((2 - FLATTENING) / (1 + (1 - FLATTENING) * root)) @ _WEIGHTS)
    return distance, longitude


def _along(alpha1, beta1, beta2, parts=_PARTS):
    """(distance / b, longitude difference) of the geodesic leaving beta1 at alpha1, when it next rises through beta2."""
    sin0 = np.sin(alpha1) * np.cos(beta1)
    cos0 = np.hypot(np.cos(alpha1), np.sin(alpha1) * np.sin(beta1))
    cos2 = np.sqrt(np.maximum(0.0, (np.cos(alpha1) * np.cos(beta1)) ** 2 + (np.cos(beta2) ** 2 - np.cos(beta1) ** 2))) / np.cos(beta2)
    sigma1 = np.arctan2(np.sin(beta1), np.cos(alpha1) * np.cos(beta1))
    sigma2 = np.arctan2(np.sin(beta2), cos2 * np.cos(beta2))
    omega1 = np.arctan2(sin0 * np.sin(sigma1), np.cos(sigma1))
    omega2 = np.arctan2(sin0 * np.sin(sigma2), np.cos(sigma2))
    second = (A / (A * (1 - FLATTENING))) ** 2 - 1
    distance, longitude = _integrals(second * cos0**2, sigma1, sigma2, parts)
    turn = np.mod(omega2 - omega1, 2 * np.pi)
    return distance, turn - FLATTENING * sin0 * longitude


def _azimuth(turn, beta1, beta2):
    """The azimuth at beta1 whose geodesic turns by ``turn``: Chandrupatla's search between 0 and pi, for those still open."""
    out, at = np.zeros_like(turn), np.arange(len(turn))
    a, b = np.full_like(turn, np.pi), np.zeros_like(turn)
    excess = lambda x, i: _along(x, beta1[i], beta2[i], 1)[1] - turn[i]
    fa, fb = excess(a, at), -turn
    c, fc, t = a, fa, np.full_like(turn, 0.5)
    for _ in range(_STEPS):
        x = a + t * (b - a)
        fx = excess(x, at)
        same = (fx < 0) == (fa < 0)
        c, fc = np.where(same, a, b), np.where(same, fa, fb)
        b, fb = np.where(same, b, a), np.where(same, fb, fa)
        a, fa = x, fx
        best = np.where(np.abs(fa) < np.abs(fb), a, b)
        out[at] = best
        least = 2e-16 * np.abs(best) + 1e-17
        span = np.abs(b - a)
        open_ = (span > 2 * least) & (fa != 0)
        if not open_.any():
            break
        a, b, c, fa, fb, fc, at, least, span = (v[open_] for v in (a, b, c, fa, fb, fc, at, least, span))
        with np.errstate(all="ignore"):
            xi, phi = (a - b) / (c - b), (fa - fb) / (fc - fb)
            inverse = fa / (fb - fa) * fc / (fb - fc) + (c - a) / (b - a) * fa / (fc - fa) * fb / (fc - fb)
            t = np.where((phi**2 < xi) & ((1 - phi) ** 2 < 1 - xi), inverse, 0.5)
        t = np.clip(np.where(np.isfinite(t), t, 0.5), least / span, 1 - least / span)
    return out


def geodesic(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Metres between arrays of points in degrees."""
    given = np.stack(np.broadcast_arrays(*(np.asarray(x, dtype=float) for x in (lon1, lat1, lon2, lat2))), axis=-1)
    pairs, at = np.unique(given.reshape(-1, 4), axis=0, return_inverse=True)
    out = np.where(np.isnan(pairs).any(axis=1), np.nan, 0.0)
    apart = (pairs[:, 0] != pairs[:, 2]) | (pairs[:, 1] != pairs[:, 3])
    apart &= ~np.isnan(pairs).any(axis=1)
    if apart.any():
        out[apart] = _geodesic(*pairs[apart].T)
    return out[at.reshape(-1)].reshape(given.shape[:-1])


def _geodesic(lon1, lat1, lon2, lat2) -> np.ndarray:
    turn = np.radians(np.abs(np.remainder(lon2 - lon1 + 180.0, 360.0) - 180.0))
    swap = np.abs(lat1) < np.abs(lat2)
    first, other = np.where(swap, lat2, lat1), np.where(swap, lat1, lat2)
    flip = first > 0
    first, other = np.where(flip, -first, first), np.where(flip, -other, other)
    beta = lambda lat: np.arctan2((1 - FLATTENING) * np.sin(np.radians(lat)), np.maximum(np.cos(np.radians(lat)), 1e-16))
    beta1, beta2 = beta(first), beta(other)
    beta1 = np.minimum(beta1, -1e-14)
    beta2 = np.clip(beta2, beta1, -beta1)
    alpha1 = _azimuth(turn, beta1, beta2)
    distance, reached = _along(alpha1, beta1, beta2)
    # the azimuth is only as fine as its floats; the first variation makes good what is left of the turn
    out = distance * A * (1 - FLATTENING) + A * np.sin(alpha1) * np.cos(beta1) * (turn - reached)
    # along the equator, and along a meridian, the answer is direct
    equator = (lat1 == 0) & (lat2 == 0) & (turn <= np.pi * (1 - FLATTENING))
    level = turn == 0
    if level.any():
        out[level] = _along(np.zeros(level.sum()), beta1[level], beta2[level])[0] * A * (1 - FLATTENING)
    out = np.where(equator, A * turn, out)
    return np.where((lat1 == lat2) & (turn == 0), 0.0, out)


@F.pandas_udf(T.DoubleType())
def geodesic_metres(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    return pd.Series(geodesic(lon1, lat1, lon2, lat2))


def _point(lon: Typed, lat: Typed) -> Result:
    if not all(isinstance(x.type, (*INTEGERS, T.DecimalType, T.DoubleType)) for x in (lon, lat)):
        return type_error("spatial:wgs84Point")
    x, y = lon.col.cast("double"), lat.col.cast("double")
    outside = F.isnan(x) | F.isnan(y) | (F.abs(x) > 180) | (F.abs(y) > 90)
    return Result(F.struct(x.alias("lon"), y.alias("lat")), fail(outside, "DOMAIN_ERROR", "a point needs a longitude within 180 and a latitude within 90 degrees"))


def _is_point(x: Typed) -> bool:
    return isinstance(x.type, T.StructType) and x.type.fieldNames() == ["lon", "lat"]


def _distance(a: Typed, b: Typed) -> Result:
    if not (_is_point(a) and _is_point(b)):
        return type_error("spatial:wgs84Distance")
    return Result(geodesic_metres(a.col["lon"], a.col["lat"], b.col["lon"], b.col["lat"]))


def _within(a: Typed, b: Typed, radius: Typed) -> Result:
    if not (_is_point(a) and _is_point(b) and isinstance(radius.type, (*INTEGERS, T.DecimalType, T.DoubleType))):
        return type_error("spatial:dwithin")
    metres = radius.col.cast("double")
    return Result(_distance(a, b).value <= metres, fail(F.isnan(metres) | (metres < 0), "DOMAIN_ERROR", "a radius can't be negative"))


OPERATIONS = [
    Operation(f"{URN}spatial:wgs84Point", 2, _point),
    Operation(f"{URN}spatial:wgs84Distance", 2, _distance),
    Operation(f"{URN}spatial:dwithin", 3, _within, boolean=True),
]
