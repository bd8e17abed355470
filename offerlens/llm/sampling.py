"""Bounded samples that stay bounded whatever the number of tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def under_quota(order: Column, wanted: int, total: Column | int) -> Column:
    """True for the rows among which the ``wanted`` smallest of ``total`` hashes lie.

    About twice the wanted number passes, spread over all tasks; so a sort that then takes
    the first ones never receives that many rows from every task. All rows pass where
    there are not many more than wanted. ``order`` is a 64-bit hash; take the first rows by
    :func:`place` of it.
    """
    total = F.lit(total) if isinstance(total, int) else total
    quota = (2.0 * wanted + 100.0) / F.greatest(total.cast("double"), F.lit(1.0))
    return place(order).cast("double") <= quota * float(1 << 53)


def place(order: Column) -> Column:
    """A hash as a whole number from 0 to 2**53."""
    return F.shiftrightunsigned(order, 11)
