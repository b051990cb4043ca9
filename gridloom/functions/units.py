"""Lengths and angles in the units of drawings, short colours, and the legacy hash of sheet passwords."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values of the file format: EMU in a pixel, centimetre and inch; angle units in a degree; dxa in an inch
EMU_PIXEL, EMU_CM, EMU_INCH, ANGLE, DXA_INCH = 9525, 360_000, 914_400, 60_000, 1440
SALT = 0xCE4B
LONGEST = 40  # characters of a password that 64 bits hold


def to_emu(value: Column, unit: int) -> Column:
    """Whole EMU of a value in ``unit`` (EMU_PIXEL, EMU_CM or EMU_INCH), cut off towards zero."""
    return (value * unit).cast("long")


def from_emu(value: Column, unit: int) -> Column:
    """Pixels as whole numbers, centimetres and inches to four places; ties go to the even digit."""
    return F.bround(value / unit, 0 if unit == EMU_PIXEL else 4)


def inch_to_dxa(value: Column) -> Column:
    return (value * DXA_INCH).cast("long")


def pixels_to_points(value: Column, dpi: int = 96) -> Column:
    return value * 72 / dpi


def points_to_pixels(value: Column, dpi: int = 96) -> Column:
    return F.ceil(value * dpi / 72)


def degrees_to_angle(value: Column) -> Column:
    return F.bround(value * ANGLE, 0).cast("long")


def angle_to_degrees(value: Column) -> Column:
    return F.bround(value / ANGLE, 2)


def short_colour(colour: Column) -> Column:
    """RRGGBB of AARRGGBB."""
    return F.when(F.length(colour) > 6, F.substr(colour, F.lit(3))).otherwise(colour)


@F.pandas_udf(T.StringType())
def _long_hash(passwords: pd.Series) -> pd.Series:
    """The same for passwords whose shifted codes need more than 64 bits."""

    def one(p: str | None) -> str | None:
        if p is None:
            return None
        h = 0
        for i, c in enumerate(p, 1):
            v = ord(c) << i
            h ^= v & 0x7FFF | v >> 15
        return f"{h ^ len(p) ^ SALT:X}"

    return passwords.map(one, na_action=None)


def password_hash(password: Column) -> Column:
    """Upper-case hexadecimal; null for a null. Only passwords of over LONGEST characters leave the JVM."""
    codes = F.transform(F.filter(F.split(password, ""), lambda c: c != ""), lambda c, i: F.call_function("shiftleft", F.ascii(c).cast("long"), i + 1))
    folded = F.aggregate(codes, F.lit(0).cast("long"), lambda h, v: h.bitwiseXOR(v.bitwiseAND(0x7FFF).bitwiseOR(F.shiftright(v, 15))))
    long = F.length(password) > LONGEST
    return F.when(long, _long_hash(F.when(long, password))).otherwise(F.hex(folded.bitwiseXOR(F.length(password).cast("long")).bitwiseXOR(SALT)))


def tinted(rgb: Column, tint: Column) -> Column:
    """RRGGBB with its lightness moved by a tint from -1 (black) to 1 (white), hue and saturation kept."""
    r, g, b = (F.conv(F.substring(rgb, i, 2), 16, 10).cast("double") / 255 for i in (1, 3, 5))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    light, spread = (high + low) / 2, high - low
    saturation = F.when(spread == 0, 0.0).when(light <= 0.5, spread / (high + low)).otherwise(spread / (2 - high - low))
    back = lambda x: (high - x) / F.nullif(spread, F.lit(0.0))
    hue = F.when(spread == 0, 0.0).when(r == high, back(b) - back(g)).when(g == high, 2 + back(r) - back(b)).otherwise(4 + back(g) - back(r)) / 6
    hue = hue - F.floor(hue)
    moved = F.when(tint < 0, light * (1 + tint)).otherwise(light * (1 - tint) + tint)
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved))
    m2 = F.when(moved <= 0.5, moved * (1 + saturation)).otherwise(moved + saturation - moved * saturation)
    m1 = 2 * moved - m2

    def channel(shift: float) -> Column:
        h = hue + shift - F.floor(hue + shift)
        v = F.when(h < 1 / 6, m1 + (m2 - m1) * h * 6).when(h < 0.5, m2).when(h < 2 / 3, m1 + (m2 - m1) * (2 / 3 - h) * 6).otherwise(m1)
        return F.lpad(F.hex(F.bround(F.when(saturation == 0, moved).otherwise(v) * 255).cast("long")), 2, "0")

    return F.concat(channel(1 / 3), channel(0.0), channel(-1 / 3))
