"""Expressions over channels, masks and settings; rounding is floor(v + 0.5) throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(v: Column) -> Column:
    return F.floor(v + F.lit(0.5))


def luma(r: str = "r", g: str = "g", b: str = "b") -> Column:
    """0..255, of all pixels: transparency counts later."""
    return rounded(F.lit(0.299) * F.col(r) + F.lit(0.587) * F.col(g) + F.lit(0.114) * F.col(b)).cast("int")


def opaque(a: str = "a", at_least: int = 10) -> Column:
    return F.col(a) >= at_least


def near_white(tolerance: int, strict: bool = False) -> Column:
    """All channels over (strict: by more than) 255 - tolerance."""
    least = F.least("r", "g", "b")
    return least > 255 - tolerance if strict else least >= 255 - tolerance


def inked(cut_off: int, a: str = "a") -> Column:
    return F.when(F.col(a) > cut_off, 1).otherwise(0)


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex(v.cast("long"))), 2, "0") for v in (r, g, b)))


def from_hex(color: Column) -> Column:
    """struct<r,g,b>; black if it isn't six hex digits with an optional #."""
    digits = F.regexp_extract(color, "^#?([0-9a-fA-F]{6})$", 1)
    part = lambda k: F.when(digits != "", F.conv(F.substring(digits, k, 2), 16, 10).cast("int")).otherwise(0)
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def marker_scale(width: Column) -> Column:
    return F.greatest(F.lit(1.0), width / F.lit(500.0))


def clamped_thresholds(limits: Column, layer: Column, value: Column) -> Column:
    """``limits`` with one edited to 1..254; layers 0 and 1 move together."""
    to = F.least(F.lit(254), F.greatest(F.lit(1), value))
    return F.transform(limits, lambda v, i: F.when((i == layer) | (layer < 2) & (i < 2), to).otherwise(v))
