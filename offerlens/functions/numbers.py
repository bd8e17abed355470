"""Whole-number and percentage arithmetic that two engines compute alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_pct(diff: Column, base: Column, decimals: int = 1) -> Column:
    """``100 * diff / base`` rounded half away from zero, in exact whole numbers.

    A floating-point product would round ties by its own representation error.
    """
    scale = 10**decimals
    magnitude = F.floor((F.abs(diff) * (200 * scale) + base) / (base * 2))
    return F.when(base != 0, F.signum(diff) * magnitude / F.lit(float(scale)))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def unit_range(v: Column, lo: Column, hi: Column) -> Column:
    """Position of ``v`` in ``[lo, hi]`` as 0..1; 0.5 when the range is empty."""
    span = (hi - lo).cast("double")
    return F.when(span <= 0, F.lit(0.5)).otherwise(clamp01((v - lo).cast("double") / F.when(span > 0, span)))
