"""Per-point and per-sample column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import COLUMNS, DEFAULT, INTENSITY_CAP, INTENSITY_REF, RINGS

PI = math.pi


def align_clock(ts_ns: Column, offset_ns: Column, initialized: Column) -> Column:
    """Stamp less the running offset, once there is one."""
    return F.when(initialized, ts_ns - offset_ns).otherwise(ts_ns)


def point_timestamp(raw: Column, header_ns: Column, offset_ns: Column, initialized: Column) -> Column:
    """Seconds of a raw stamp: nanoseconds above 1e15, seconds above 1e9 (both moved to the aligned clock), else an
    offset from the header; without a stamp the header's."""
    seconds = F.when(raw > 1e15, raw / 1e9).otherwise(raw)
    aligned = align_clock((seconds * 1e9).cast("long"), offset_ns, initialized).cast("double") / 1e9
    header = header_ns.cast("double") / 1e9
    return F.when(raw.isNull(), header).when(raw > 1e9, aligned).otherwise(header + raw)


def normalized_intensity(x: Column, y: Column, z: Column, i: Column) -> Column:
    """Beyond 1 m, scaled by the squared range against the reference range, and capped."""
    r2 = x * x + y * y + z * z
    scaled = F.least(F.lit(INTENSITY_CAP), i * F.greatest(F.lit(1.0), r2 / (INTENSITY_REF * INTENSITY_REF)))
    return F.when(r2 > 1.0, scaled).otherwise(i)


def planar_range(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def bearing(x: Column, y: Column) -> Column:
    return F.atan2(y, x)


def degrees(x: Column, y: Column) -> Column:
    """Azimuth in [0, 360)."""
    d = F.atan2(y, x) * 180.0 / PI
    return F.when(d < 0, d + 360.0).otherwise(d)


def sector(x: Column, y: Column, segments: int) -> Column:
    return (F.floor(degrees(x, y) / (360.0 / segments)) % segments).cast("int")


def radial_bin(x: Column, y: Column, bins: int, max_range: float) -> Column:
    return F.least(F.lit(bins - 1), F.floor(planar_range(x, y) / (max_range / bins)).cast("int"))


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("int")


def toward_zero(v: Column) -> Column:
    """Truncated to a whole number, as integer conversion does."""
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("int")


def image_column(x: Column, y: Column) -> Column:
    return (F.floor((F.atan2(y, x) + PI) / (2.0 * PI) * COLUMNS) % COLUMNS).cast("int")


def in_image(ring: Column) -> Column:
    return (ring >= 0) & (ring < RINGS)


#: Degrees between rings, by first and last ring; the first range that holds a ring counts.
RING_STEPS = ((6, 30, 0.33), (5, 6, 1.0), (30, 38, 1.0), (4, 5, 2.0), (2, 4, 3.0), (1, 2, 4.0), (38, 39, 5.0))


def ring_step(ring: Column) -> Column:
    """Vertical resolution of a ring in radians."""
    out = F.lit(6.0 * PI / 180.0)
    for lo, hi, d in reversed(RING_STEPS):
        out = F.when((ring >= lo) & (ring <= hi), d * PI / 180.0).otherwise(out)
    return out


def beta(d1: Column, d2: Column, alpha: Column) -> Column:
    """Angle at the farther of two returns that are alpha apart as seen by the sensor."""
    near, far = F.least(d1, d2), F.greatest(d1, d2)
    return F.atan2(near * F.sin(alpha), far - near * F.cos(alpha))


def clamped(v: Column, most: float) -> Column:
    """Not-a-number is 0; others lie in [-most, most]."""
    return F.when(F.isnan(v), 0.0).otherwise(F.greatest(F.lit(-most), F.least(F.lit(most), v)))


def finite(*cs: Column) -> Column:
    out = F.lit(True)
    for c in cs:
        out = out & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


GYRO_LIMIT, ACCEL_LIMIT = 15.0, 80.0
MAX_RANGE = DEFAULT.max_range
