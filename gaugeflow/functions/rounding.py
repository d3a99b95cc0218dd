"""Decimal rounding of doubles as scaled rounding of the binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """Nearest multiple of 10**-digits, halves away from zero.

    The scaled product is rounded, so 34.355 (stored slightly below) gives
    34.35; the built-in rounds the printed decimal and would give 34.36.
    """
    scale = float(10 ** digits)
    return F.round(value * scale, 0) / scale
