"""Coupling functions and plasma quantities, row by row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PROTON_MASS, MU_0 = 1.67e-27, 4e-7 * math.pi


def _opening_angle(by: Column, bz: Column) -> Column:
    angle = F.atan2(F.abs(by), F.abs(bz) + 1e-10)
    return F.when(bz < 0, angle).otherwise(math.pi - angle)


def _all_known(*columns: Column) -> Column:
    out = columns[0].isNotNull()
    for c in columns[1:]:
        out = out & c.isNotNull()
    return out


def newell_energy(n: Column, v: Column, bx: Column, by: Column, bz: Column) -> Column:
    """3.78e7 n^.24 v^1.47 (bx²+by²)^.43 (sin(angle / 2)^2.7 + .25); without bz the sine's term is 0."""
    sine = F.when(bz.isNull(), 0.0).otherwise(F.pow(F.sin(_opening_angle(by, bz) / 2), F.lit(2.7)))
    return F.when(_all_known(n, v, bx, by), 3.78e7 * F.pow(n, F.lit(0.24)) * F.pow(v, F.lit(1.47)) * F.pow(bx * bx + by * by, F.lit(0.43)) * (sine + 0.25))


def epsilon(v: Column, b: Column, by: Column, bz: Column) -> Column:
    """1.997e7 v B² sin⁴(angle / 2), 0 where by is 0, with an angle of a quarter turn where bz is 0."""
    sine = F.when(by == 0, 0.0).when(bz == 0, math.sin(math.pi / 4) ** 4).otherwise(F.pow(F.sin(_opening_angle(by, bz) / 2), F.lit(4)))
    return F.when(_all_known(v, b, by, bz), 1.997e7 * v * b * b * sine)


def dynamic_pressure(n: Column, v: Column) -> Column:
    """Density in 1/m³ with the factor for 1/cm³, as feature sets in use have it: 10⁶ times the pressure in nPa."""
    return 1.67e-6 * (n * 1e6) * v * v


def electric_field(v: Column, bz: Column) -> Column:
    return F.when(_all_known(v, bz), F.greatest(F.lit(0.0), v * -bz * 1e-3))


def alfven_mach(v: Column, b: Column, n: Column) -> Column:
    """Speed (km/s) over the Alfvén speed; null where that isn't positive."""
    root = F.sqrt(F.when(n > 0, MU_0 * (n * 1e6) * PROTON_MASS))
    speed = F.try_divide(b * 1e-9, root) / 1000
    return F.when(speed > 0, F.try_divide(v, speed))
