"""Column builders on single values: text, dates, plane geometry, atmosphere, quantisation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- text and dates


def url(base: str, params: dict[str, Column]) -> Column:
    """``base`` and the parameters as a query string, in the order given."""
    return F.concat(F.lit(base), F.concat_ws("&", *[F.concat(F.lit(k + "="), F.replace(v.cast("string"), F.lit(":"), F.lit("%3A"))) for k, v in params.items()]))


def parse_date(x: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """A date of exactly this form; null for anything else."""
    return F.try_to_timestamp(x, F.lit(pattern)).cast("date")


def parse_any(x: Column) -> Column:
    """A timestamp of any ISO form; null for anything else."""
    return F.try_to_timestamp(x)


# ---- plane geometry; a zero vector has no direction, so its unit is null


def length(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def with_length(x: Column, y: Column, size: Column | float) -> tuple[Column, Column]:
    """The vector of this direction and the given length."""
    n = length(x, y)
    return F.try_divide(x, n) * size, F.try_divide(y, n) * size


def limited(x: Column, y: Column, most: float) -> tuple[Column, Column]:
    """The vector, shortened to ``most`` if it is longer."""
    k = F.when(length(x, y) > most, most / length(x, y)).otherwise(1.0)
    return x * k, y * k


def heading(x: Column, y: Column) -> Column:
    """The angle on a screen, whose y points down."""
    return F.atan2(-y, x)


def rotated(x: Column, y: Column, degrees: Column | float) -> tuple[Column, Column]:
    a = F.radians(degrees if isinstance(degrees, Column) else F.lit(degrees))
    return x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a)


def reflected(x: Column, y: Column, nx: Column, ny: Column) -> tuple[Column, Column]:
    """The vector mirrored at the line whose normal is (nx, ny)."""
    k = F.try_divide(2 * (x * nx + y * ny), nx * nx + ny * ny)
    return x - k * nx, y - k * ny


def projected(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column, Column]:
    """(x, y, distance from a along a-b) of the foot of p on the line through a and b."""
    dx, dy = bx - ax, by - ay
    along = F.try_divide((px - ax) * dx + (py - ay) * dy, length(dx, dy))
    ux, uy = with_length(dx, dy, 1.0)
    return ax + ux * along, ay + uy * along, along


def in_sector(dx: Column, dy: Column, radius: float, start: float, stop: float) -> Column:
    """Whether an offset lies in the sector between two angles (radians, from the y axis), edges included."""
    theta = F.atan2(dx, dy) - start
    theta = F.when(theta < 0, 2 * math.pi + theta).otherwise(theta)
    return (dx * dx + dy * dy <= radius * radius) & (theta <= stop - start)


def sees(dx: Column, dy: Column, direction: Column, reach: float, half_angle: float) -> Column:
    """Whether an offset is nearer than ``reach`` and its angle less than ``half_angle`` degrees from the direction."""
    return (length(dx, dy) < reach) & (F.abs(direction - F.degrees(F.atan2(dy, dx))) < half_angle)


# ---- atmosphere

#: Boltzmann, Planck and light in SI units; sea-level pressure (Pa) and its scale height (m).
K_B, H, C = 1.380649e-23, 6.62607015e-34, 299_792_458.0
P0, SCALE_HEIGHT = 101_325.0, 8_500.0
#: The layers of the standard atmosphere from their base in km: (base, temperature there in K, K a km).
LAYERS = ((0, 288.15, -6.5), (11, 216.65, 0.0), (20, 216.65, 1.0), (32, 228.65, 2.8), (47, 270.65, 0.0), (51, 270.65, -2.8), (71, 214.65, -2.0))


def temperature(z: Column, sea: float = 288.2, lapse: float = -0.0065, top: float = 11_000.0) -> Column:
    """Falling up to the tropopause, constant above."""
    return F.lit(sea) + F.lit(lapse) * F.least(z, F.lit(top))


def standard_temperature(z: Column) -> Column:
    km = z / 1000.0
    out = F.lit(None).cast("double")
    for base, t, rate in LAYERS:
        out = F.when((km >= base) | F.lit(base == 0), F.lit(t) + (km - base) * rate).otherwise(out)
    return out


def pressure(z: Column) -> Column:
    return F.lit(P0) * F.exp(-z / SCALE_HEIGHT)


def number_density(z: Column) -> Column:
    """Molecules a cubic metre, at the temperature of ``temperature``."""
    return pressure(z) / (K_B * temperature(z))


def planck(wavelength: Column, t: Column) -> Column:
    """Spectral radiance of a black body (W / m^2 / sr / m)."""
    return F.lit(2 * H * C**2) / F.pow(wavelength, F.lit(5.0)) / (F.exp(F.lit(H * C / K_B) / (wavelength * t)) - 1)


def absorption_band(wavelength: Column, centre: float = 15.0e-6) -> Column:
    """Cross-section (m^2) falling off on both sides of a band."""
    return F.pow(F.lit(10.0), -22.5 - 24 * F.abs((wavelength - centre) / centre))


# ---- quantisation and rasters


def to_int16(x: Column, top: Column) -> Column:
    """x as a share of ``top`` in 1/32767, cut off towards zero."""
    return (F.try_divide(x, top) * 32767).cast("smallint")


def centred_int16(x: Column, mean: Column) -> Column:
    return (x - mean).cast("smallint")


def corner_code(a: Column, b: Column, c: Column, d: Column) -> Column:
    """0 to 15: which corners of a cell are above zero."""
    bit = lambda x, k: F.ceil(x).cast("int") * k
    return bit(a, 8) + bit(b, 4) + bit(c, 2) + bit(d, 1)


def packed_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16) + F.shiftleft(g.cast("int"), 8) + b.cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def between_knots(x: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Linear between two knots, constant outside."""
    return F.lit(y0) + F.lit((y1 - y0) / (x1 - x0)) * (F.greatest(F.lit(min(x0, x1)), F.least(F.lit(max(x0, x1)), x)) - x0)


# ---- repeatable random numbers


def uniform(key: Column, salt: str = "") -> Column:
    """A number from 0 to under 1 by the md5 of salt and key: the same at every run and in any order."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def normal(key: Column, salt: str = "") -> Column:
    """A standard normal number of two uniform ones."""
    return F.sqrt(-2 * F.ln(1 - uniform(key, salt + "a"))) * F.cos(2 * math.pi * uniform(key, salt + "b"))
