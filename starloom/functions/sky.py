"""Sky and detector geometry as column expressions. Angles are degrees, separations arcseconds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def separation(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle separation by the haversine formula, guarded against rounding above 1; null if any part is."""
    d1, d2 = F.radians(_c(dec1)), F.radians(_c(dec2))
    a, b = F.sin((d2 - d1) / 2), F.sin(F.radians(_c(ra2) - _c(ra1)) / 2)
    h = a * a + F.cos(d1) * F.cos(d2) * b * b
    return F.when(h.isNotNull(), F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))) * 3600)


def position_angle(ra1, dec1, ra2, dec2) -> Column:
    """Direction from the first to the second position, east of north, in [0, 360)."""
    d1, d2, r = F.radians(_c(dec1)), F.radians(_c(dec2)), F.radians(_c(ra2) - _c(ra1))
    return F.pmod(F.degrees(F.atan2(F.sin(r) * F.cos(d2), F.cos(d1) * F.sin(d2) - F.sin(d1) * F.cos(d2) * F.cos(r))), F.lit(360.0))


def offsets(ra1, dec1, ra2, dec2) -> tuple[Column, Column]:
    """Small-angle offsets (east, north) of the second position from the first."""
    wrapped = F.pmod(_c(ra2) - _c(ra1) + 180, F.lit(360.0)) - 180
    return wrapped * F.cos(F.radians(_c(dec1))) * 3600, (_c(dec2) - _c(dec1)) * 3600


def angle_difference(a, b) -> Column:
    """Difference of two directions, in [0, 180]."""
    return F.abs(F.pmod(_c(a) - _c(b) + 180, F.lit(360.0)) - 180)


def julian_year(mjd) -> Column:
    return 2000 + (_c(mjd) - 51544.5) / 365.25


def mjd_of(ts: Column) -> Column:
    """Modified Julian date of a UTC timestamp."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86_400_000_000.0) + 40587


def months(days) -> Column:
    return _c(days) / (365.25 / 12)


def propagated(ra, dec, pmra, pmdec, from_year, to_year) -> tuple[Column, Column]:
    """Position moved by proper motion (mas / year, the first with cos(dec) in it); missing motions count as 0."""
    years = _c(to_year) - _c(from_year)
    east = F.coalesce(_c(pmra), F.lit(0.0)) * years / 3_600_000
    return _c(ra) + east / F.cos(F.radians(_c(dec))), _c(dec) + F.coalesce(_c(pmdec), F.lit(0.0)) * years / 3_600_000


def catalogue_sigma(ra_error, dec_error, pm_error, parallax, years, has_pm, allowance: float = 20.0) -> Column:
    """Positional error (arcsec) of a catalogue star after ``years``; errors come in mas, without a motion ``allowance`` mas a year count."""
    base = (_c(ra_error) * _c(ra_error) + _c(dec_error) * _c(dec_error)) / 2
    drift = F.when(_c(has_pm), F.coalesce(_c(pm_error), F.lit(0.0))).otherwise(F.lit(allowance)) * F.abs(_c(years))
    swing = F.greatest(F.coalesce(_c(parallax), F.lit(0.0)), F.lit(0.0)) / 2
    return F.sqrt(base + drift * drift + swing * swing) / 1000


def chi_square(sep, *sigmas) -> Column:
    var = sum((_c(s) * _c(s) for s in sigmas[1:]), _c(sigmas[0]) * _c(sigmas[0]))
    return F.try_divide(_c(sep) * _c(sep), var)


def chance(density, sep) -> Column:
    """Probability of an unrelated source within ``sep`` at a surface density."""
    return 1 - F.exp(-math.pi * _c(density) * _c(sep) * _c(sep))


def sigma_model(snr1, snr2, floor, k) -> Column:
    """Expected positional scatter of a matched pair from both signal-to-noise ratios."""
    return F.sqrt(_c(floor) * _c(floor) + _c(k) * _c(k) * (1 / (_c(snr1) * _c(snr1)) + 1 / (_c(snr2) * _c(snr2))))


def expected_tail(n, t) -> Column:
    """Expected number out of ``n`` beyond ``t`` sigma of a two-dimensional Gaussian."""
    return _c(n) * F.exp(-_c(t) * _c(t) / 2)


def magnitude(flux) -> Column:
    return F.when(_c(flux) > 0, -2.5 * F.log10(_c(flux)))


def tan_to_pixel(ra, dec, wcs: dict) -> tuple[Column, Column]:
    """0-based pixel of a sky position under a gnomonic (TAN) world system: crval, crpix (1-based) and cd matrix, as numbers or columns."""
    w = {k: _c(v) for k, v in wcs.items() if k not in ("a", "b", "ap", "bp")}
    d0, r, d = F.radians(w["crval2"]), F.radians(_c(ra)) - F.radians(w["crval1"]), F.radians(_c(dec))
    cos = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(r)
    xi = F.when(cos > 0, F.degrees(F.cos(d) * F.sin(r) / cos))
    eta = F.when(cos > 0, F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(r)) / cos))
    a, b, c, e = w["cd11"], w["cd12"], w["cd21"], w["cd22"]
    det = a * e - b * c
    u, v = (e * xi - b * eta) / det, (a * eta - c * xi) / det
    if "ap" in wcs:
        u, v = u + polynomial(u, v, wcs["ap"]), v + polynomial(u, v, wcs["bp"])
    return u + w["crpix1"] - 1, v + w["crpix2"] - 1


def tan_to_sky(x, y, wcs: dict) -> tuple[Column, Column]:
    """Sky position of a 0-based pixel under a gnomonic world system, with SIP distortion (a, b: (i, j) to coefficient) if it has any."""
    w = {k: _c(v) for k, v in wcs.items() if k not in ("a", "b", "ap", "bp")}
    u, v = _c(x) + 1 - w["crpix1"], _c(y) + 1 - w["crpix2"]
    if "a" in wcs:
        u, v = u + polynomial(u, v, wcs["a"]), v + polynomial(u, v, wcs["b"])
    xi, eta = F.radians(w["cd11"] * u + w["cd12"] * v), F.radians(w["cd21"] * u + w["cd22"] * v)
    d0 = F.radians(w["crval2"])
    den = F.cos(d0) - eta * F.sin(d0)
    ra = F.pmod(w["crval1"] + F.degrees(F.atan2(xi, den)), F.lit(360.0))
    return ra, F.degrees(F.atan2(F.sin(d0) + eta * F.cos(d0), F.sqrt(xi * xi + den * den)))


def polynomial(u: Column, v: Column, terms: dict[tuple[int, int], float]) -> Column:
    """Sum of c * u ** i * v ** j over the terms (i, j): c."""
    power = lambda x, n: F.lit(1.0) if n == 0 else F.pow(x, F.lit(float(n)))
    return sum((F.lit(float(c)) * power(u, i) * power(v, j) for (i, j), c in terms.items()), F.lit(0.0))


def unit_vector(ra, dec) -> tuple[Column, Column, Column]:
    r, d = F.radians(_c(ra)), F.radians(_c(dec))
    return F.cos(d) * F.cos(r), F.cos(d) * F.sin(r), F.sin(d)


def in_frame(x, y, width, height, margin: float = 0.0) -> Column:
    """Whether a pixel position lies on the detector: pixel centres are whole numbers."""
    return (_c(x) >= -0.5 + margin) & (_c(x) < _c(width) - 0.5 - margin) & (_c(y) >= -0.5 + margin) & (_c(y) < _c(height) - 0.5 - margin)


def rectangle_distance(x, y, x0, y0, x1, y1) -> Column:
    dx, dy = F.greatest(_c(x0) - _c(x), F.lit(0.0), _c(x) - _c(x1)), F.greatest(_c(y0) - _c(y), F.lit(0.0), _c(y) - _c(y1))
    return F.sqrt(dx * dx + dy * dy)
