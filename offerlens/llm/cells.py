"""Distributed running sums: no window ever holds a whole key or table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_cell(value: Column, bits: int = 20) -> Column:
    """The top ``bits`` bits of a 64-bit hash, as a cell number from 0."""
    return F.shiftrightunsigned(value, 64 - bits)


def running_sum(
    df: DataFrame, keys: Sequence[str], cell: str, order: Sequence[str], value: str, out: str, shifts: Sequence[int] = (10, 20)
) -> DataFrame:
    """Sum of ``value`` over the rows of a key that sort before each row by (cell, order).

    ``keys`` and ``cell`` must not be null; ``cell`` is a whole number from 0. Sums are
    taken per cell first, then carried over the cells in a tree: a level groups cells by
    dropping the bits of ``shifts``, so an inner window sees one group of cells and the
    rows of one cell only. Rows equal in cell and order get their places in any order.
    """
    keys = list(keys)
    levels = [F.col("_cell"), *[F.shiftright("_cell", s) for s in shifts]]
    leaf = df.groupBy(*keys, F.col(cell).alias("_cell")).agg(F.sum(value).alias("_s"))
    leaf = leaf.select(*keys, "_s", *[c.alias(f"_p{i}") for i, c in enumerate(levels)])
    tables = [leaf]
    for i in range(1, len(levels)):
        kept = [f"_p{j}" for j in range(i, len(levels))]
        tables.append(tables[-1].groupBy(*keys, *kept).agg(F.sum("_s").alias("_s")))
    carried = None
    for i in range(len(levels) - 1, -1, -1):
        parents = [f"_p{j}" for j in range(i + 1, len(levels))]
        w = Window.partitionBy(*keys, *parents).orderBy(f"_p{i}") if keys or parents else Window.orderBy(f"_p{i}")
        step = tables[i].withColumn("_step", F.sum("_s").over(w) - F.col("_s")).drop("_s")
        if carried is not None:
            step = step.join(carried, [*keys, *parents]).withColumn("_step", F.col("_step") + F.col("_carried")).drop("_carried")
        carried = step.withColumnRenamed("_step", "_carried")
    carried = carried.select(*keys, F.col("_p0").alias(cell), "_carried")
    inside = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(carried, [*keys, cell])
    return joined.withColumn(out, F.col("_carried") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_carried")
