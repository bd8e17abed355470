"""Grouped operators that hold when one group has a third of all rows.

Each one pre-aggregates before it shuffles, and every window below runs over a
group whose size has a bound that does not come from the row count of one key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.plans.store import stored


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group.

    ``row_number() <= k`` lets Spark put a window group limit before the shuffle,
    so a hot group sends at most ``k`` rows from each map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first under ``order``, which must be total."""
    return top_per_group(df, keys, order, 1, "_latest").drop("_latest")


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, Callable[[Column], Column]],
    weight: str | None = None,
    shifts: Sequence[int] = (20, 0),
    count_as: str = "n",
) -> DataFrame:
    """Exact values at given 1-based ranks of a whole-number column, per key.

    ``ranks`` maps an output name to a function from the group's row count to a
    rank. Equal values are counted first (``weight`` names a column when ``df``
    already holds such counts). The wanted rank is then located digit by digit:
    each level counts rows per value prefix, walks the prefixes in order, and
    keeps only the prefix that contains the rank. With the default shifts a level
    has at most 2**20 prefixes for values below 2**40; pass ``(40, 20, 0)`` for
    the full range. No step sees the raw rows of a key together.
    """
    keys = list(keys)
    held = df.where(F.col(value).isNotNull())
    n = F.sum(weight) if weight else F.count(F.lit(1))
    current = held.groupBy(*keys, value).agg(n.cast("bigint").alias("_n"))
    ladder = current
    parents: list[str] = []
    names = list(ranks)
    for level, shift in enumerate(shifts):
        digit = f"_d{level}"
        current = current.withColumn(digit, F.shiftright(F.col(value), shift))
        group = [*keys, *parents]
        if level == 0:
            counts = current.groupBy(*group, digit).agg(F.sum("_n").alias("_n"))
            total = F.sum("_n").over(Window.partitionBy(*group))
            counts = counts.withColumn("_total", total)
            for name in names:
                counts = counts.withColumn(f"_r_{name}", ranks[name](F.col("_total")).cast("bigint"))
        else:
            carried = ["_total", *[f"_r_{name}" for name in names]]
            counts = current.groupBy(*group, digit).agg(
                F.sum("_n").alias("_n"), *[F.first(c).alias(c) for c in carried]
            )
        upto = F.sum("_n").over(Window.partitionBy(*group).orderBy(digit))
        counts = counts.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n"))
        hits = [
            (F.col(f"_r_{name}") > F.col("_before")) & (F.col(f"_r_{name}") <= F.col("_upto")) for name in names
        ]
        any_hit = hits[0]
        for hit in hits[1:]:
            any_hit = any_hit | hit
        counts = counts.where(any_hit)
        for name, hit in zip(names, hits):
            counts = counts.withColumn(f"_r_{name}", F.when(hit, F.col(f"_r_{name}") - F.col("_before")))
        kept = counts.select(*group, digit, "_total", *[f"_r_{name}" for name in names])
        if shift == 0:
            found = [
                F.max(F.when(F.col(f"_r_{name}").isNotNull(), F.col(digit))).alias(name) for name in names
            ]
            return kept.groupBy(*keys).agg(F.max("_total").alias(count_as), *found)
        parents.append(digit)
        prefixed = ladder
        for i, s in enumerate(shifts[: level + 1]):
            prefixed = prefixed.withColumn(f"_d{i}", F.shiftright(F.col(value), s))
        current = prefixed.join(kept, [*keys, *parents])
    raise ValueError("the last shift must be 0")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, out: str = "median") -> DataFrame:
    """Whole-number median per key: the middle value, or the floored mean of two."""
    middle = {"_low": lambda n: F.floor((n + 1) / 2), "_high": lambda n: F.floor(n / 2) + 1}
    stats = order_statistics(df, keys, value, middle, weight)
    return stats.select(*keys, "n", F.floor((F.col("_low") + F.col("_high")) / 2).cast("bigint").alias(out))


def running_totals(df: DataFrame, value: str, weight: str, out: str = "upto", shifts: Sequence[int] = (20, 40)) -> DataFrame:
    """``value`` and the sum of ``weight`` over all rows with this value or a smaller one.

    Equal values are added up first; sums are then carried over a tree of value prefixes,
    so no window holds more than the distinct values of one prefix. Values are whole
    numbers from 0.
    """
    prefixes = [f"_p{i}" for i in range(len(shifts))]
    table = df.groupBy(value).agg(F.sum(weight).cast("bigint").alias("_n"))
    tables = [table.select(value, "_n", *[F.shiftright(value, s).alias(p) for s, p in zip(shifts, prefixes)])]
    for i in range(len(shifts)):
        tables.append(tables[-1].groupBy(*prefixes[i:]).agg(F.sum("_n").alias("_n")))
    names, carried = [value, *prefixes], None
    for i in range(len(names) - 1, -1, -1):
        parents = names[i + 1 :]
        w = Window.partitionBy(*parents).orderBy(names[i])
        step = tables[i].withColumn("_upto", F.sum("_n").over(w))
        if carried is not None:
            step = step.join(carried, parents).withColumn("_upto", F.col("_upto") + F.col("_before")).drop("_before")
        carried = step.withColumn("_before", F.col("_upto") - F.col("_n")).select(*names[i:], "_before", *(["_upto"] if i == 0 else []))
    return carried.select(value, F.col("_upto").alias(out))


def offsets(df: DataFrame, keys: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """Rows of the group that sort before each cell of ``levels``.

    ``levels`` refine the order step by step (flag, price band, price, hash cell);
    rows are counted per cell and each level is walked inside its parent cell.
    """
    keys, levels = list(keys), list(levels)
    leaf = df.groupBy(*keys, *levels).agg(F.count(F.lit(1)).alias("_n"))
    total = leaf.select(*keys, *levels, F.lit(0).cast("bigint").alias("_offset"))
    for depth in range(len(levels)):
        parent, cell = [*keys, *levels[:depth]], [*keys, *levels[: depth + 1]]
        w = Window.partitionBy(*parent).orderBy(levels[depth])
        step = leaf.groupBy(*cell).agg(F.sum("_n").alias("_n"))
        step = step.select(*cell, (F.sum("_n").over(w) - F.col("_n")).alias("_step"))
        total = total.join(step, cell).withColumn("_offset", F.col("_offset") + F.col("_step")).drop("_step")
    return total


def positions(df: DataFrame, keys: Sequence[str], levels: Sequence[str], tiebreak: Sequence[str] = (), out: str = "position", only_order: Sequence[str] = ()) -> DataFrame:
    """0-based position of each row in its group under ``levels`` then ``tiebreak``, nulls last.

    Rows are sorted once over ranges of the whole order, so a hot group spans as many tasks as
    it needs, and numbered in their task; a group's offset in a task is its rows in the tasks
    before, one count a group and task. Columns in ``only_order`` end with the sort.
    """
    keys = list(keys)
    order = [F.asc_nulls_last(c) for c in (*keys, *levels, *tiebreak)]
    rows = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).drop(*only_order), "ordered")
    # The high digits of the number are its task.
    rows = rows.withColumn("_task", F.shiftright("_at", 33))
    runs = rows.groupBy(*keys, "_task").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_task")) - F.col("_n")
    starts = runs.withColumn("_before", earlier).drop("_n")
    numbered = rows.join(starts, [*keys, "_task"])
    return numbered.withColumn(out, F.col("_before") + F.col("_at") - F.col("_from")).drop("_at", "_task", "_from", "_before")
