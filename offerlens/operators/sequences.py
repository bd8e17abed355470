"""Rules that run along the rows of a key in time order, without walking a key in one task.

A key's time line is a tree of cells: seconds in hours in days. What a rule needs to know of
a cell is small and is put together from its parts, so each window below sees the rows of
one second, the seconds of an hour, the hours of a day or the days of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.plans.store import stored

#: Sizes of the cells in microseconds, smallest first.
LEVELS = (1_000_000, 3_600_000_000, 86_400_000_000)


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _cells(us: Column, levels: Sequence[int]) -> dict[str, Column]:
    return {f"_c{i}": F.floor(us / size).cast("bigint") for i, size in enumerate(levels)}


def running_total(
    df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str], value: Column, out: str, reset: Column | None = None,
    inclusive: bool = True, levels: Sequence[int] = LEVELS,
) -> DataFrame:
    """Sum of a whole-number ``value`` per key in time order since the last row with ``reset``.

    A row that resets counts from its own value on. Without ``reset`` the sum runs from the
    key's first row. ``inclusive=False`` leaves out the row's own value (without resets). A
    stretch of rows is told by its sum since its last reset and by whether it has one; two
    such tales join to one, so they are carried up and down the tree of cells. ``ts`` and
    ``tiebreak`` order the rows; rows equal in both follow in any order.
    """
    keys = list(keys)
    names = [f"_c{i}" for i in range(len(levels))]
    again = F.lit(False) if reset is None else F.coalesce(reset, F.lit(False))
    rows = df.withColumns({"_v": F.coalesce(value.cast("bigint"), F.lit(0)), "_r": again, **_cells(micros(ts), levels)})

    def scanned(part: DataFrame, group: list[str], order: list[str]) -> DataFrame:
        """Adds ``_t`` and ``_seen``: the tale of the group up to and with each row."""
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        part = part.withColumn("_sum", F.sum("_v").over(w))
        base = F.last(F.when(F.col("_r"), F.col("_sum") - F.col("_v")), ignorenulls=True).over(w)
        return part.withColumn("_base", base).withColumns({"_t": F.col("_sum") - F.coalesce("_base", F.lit(0)), "_seen": F.col("_base").isNotNull()}).drop("_sum", "_base")

    inner = scanned(rows, [*keys, names[0]], [ts, *tiebreak])
    tale = F.max_by(F.struct(F.col("_t").alias("v"), F.col("_seen").alias("r")), F.struct(ts, *tiebreak)).alias("_e")
    cells = inner.groupBy(*keys, *names).agg(tale).select(*keys, *names, F.col("_e.v").alias("_v"), F.col("_e.r").alias("_r"))
    tables = []
    for i in range(len(names)):
        group, order = [*keys, *names[i + 1 :]], [names[i]]
        level = scanned(cells, group, order)
        w = Window.partitionBy(*group).orderBy(*order)
        tables.append(level.withColumns({"_before": F.coalesce(F.lag("_t").over(w), F.lit(0)), "_cut": F.coalesce(F.lag("_seen").over(w), F.lit(False))}))
        last = F.max_by(F.struct(F.col("_t").alias("v"), F.col("_seen").alias("r")), names[i]).alias("_e")
        if i + 1 < len(names):
            cells = level.groupBy(*group).agg(last).select(*group, F.col("_e.v").alias("_v"), F.col("_e.r").alias("_r"))
    carried = None
    for i in range(len(names) - 1, -1, -1):
        step = tables[i].select(*keys, *names[i:], "_before", "_cut")
        if carried is not None:
            step = step.join(carried, [*keys, *names[i + 1 :]])
            step = step.withColumn("_before", F.when(F.col("_cut"), F.col("_before")).otherwise(F.col("_before") + F.col("_above"))).drop("_above")
        carried = step.select(*keys, *names[i:], F.col("_before").alias("_above"))
    total = F.when(F.col("_seen"), F.col("_t")).otherwise(F.col("_t") + F.col("_above"))
    joined = inner.join(carried.select(*keys, names[0], "_above"), [*keys, names[0]])
    return joined.withColumn(out, total if inclusive else total - F.col("_v")).drop("_v", "_r", "_t", "_seen", "_above", *names)


def first_at_or_after(rows: DataFrame, asked: DataFrame, keys: Sequence[str], at: str, out: str, levels: Sequence[int] = LEVELS) -> DataFrame:
    """For each question (keys, ``at`` in microseconds) the smallest ``at`` of a row of its key
    that is not before it, null if there is none.

    Rows and questions lie on one time line; a question looks into its own second, then a
    cell is known by its first row only. Other columns of ``asked`` pass through.
    """
    keys = list(keys)
    names = [f"_c{i}" for i in range(len(levels))]
    more = [c for c in asked.columns if c not in (*keys, at)]
    line = rows.select(*keys, at, F.lit(1).alias("_row")).distinct().unionByName(asked.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    line = line.withColumns(_cells(F.col(at), levels))
    onward = Window.partitionBy(*keys, names[0]).orderBy(at, "_row").rowsBetween(0, Window.unboundedFollowing)
    inner = line.withColumn("_here", F.min(F.when(F.col("_row") == 1, F.col(at))).over(onward)).where("_row = 0")
    cells = line.groupBy(*keys, *names).agg(F.min(F.when(F.col("_row") == 1, F.col(at))).alias("_first"))
    tables = []
    for i in range(len(names)):
        group = [*keys, *names[i + 1 :]]
        later = Window.partitionBy(*group).orderBy(names[i]).rowsBetween(1, Window.unboundedFollowing)
        tables.append(cells.withColumn("_later", F.min("_first").over(later)))
        if i + 1 < len(names):
            cells = cells.groupBy(*group).agg(F.min("_first").alias("_first"))
    known = None
    for i in range(len(names) - 1, -1, -1):
        step = tables[i].select(*keys, *names[i:], "_later")
        if known is not None:
            step = step.join(known, [*keys, *names[i + 1 :]]).withColumn("_later", F.coalesce("_later", "_above")).drop("_above")
        known = step.select(*keys, *names[i:], F.col("_later").alias("_above"))
    joined = inner.join(known.select(*keys, names[0], "_above"), [*keys, names[0]])
    return joined.select(*keys, at, *more, F.coalesce("_here", "_above").alias(out))


def next_of(df: DataFrame, keys: Sequence[str], at: str, classes: dict[str, Column], levels: Sequence[int] = LEVELS) -> DataFrame:
    """Adds for each class the smallest ``at`` of a later row of the key that belongs to it.

    Rows of a key differ in ``at``. A cell is known by its first row of each class.
    """
    keys, out = list(keys), list(classes)
    names = [f"_c{i}" for i in range(len(levels))]
    line = df.withColumns({**_cells(F.col(at), levels), **{f"_f_{c}": F.when(test, F.col(at)) for c, test in classes.items()}})
    onward = Window.partitionBy(*keys, names[0]).orderBy(at).rowsBetween(1, Window.unboundedFollowing)
    inner = line.withColumns({f"_h_{c}": F.min(f"_f_{c}").over(onward) for c in out})
    cells = line.groupBy(*keys, *names).agg(*[F.min(f"_f_{c}").alias(f"_f_{c}") for c in out])
    tables = []
    for i in range(len(names)):
        group = [*keys, *names[i + 1 :]]
        later = Window.partitionBy(*group).orderBy(names[i]).rowsBetween(1, Window.unboundedFollowing)
        tables.append(cells.select(*keys, *names[i:], *[F.min(f"_f_{c}").over(later).alias(f"_l_{c}") for c in out]))
        if i + 1 < len(names):
            cells = cells.groupBy(*group).agg(*[F.min(f"_f_{c}").alias(f"_f_{c}") for c in out])
    known = None
    for i in range(len(names) - 1, -1, -1):
        step = tables[i]
        if known is not None:
            step = step.join(known, [*keys, *names[i + 1 :]])
            step = step.withColumns({f"_l_{c}": F.coalesce(f"_l_{c}", f"_a_{c}") for c in out}).drop(*[f"_a_{c}" for c in out])
        known = step.select(*keys, *names[i:], *[F.col(f"_l_{c}").alias(f"_a_{c}") for c in out])
    joined = inner.join(known.select(*keys, names[0], *[f"_a_{c}" for c in out]), [*keys, names[0]])
    return joined.select(*df.columns, *[F.coalesce(f"_h_{c}", f"_a_{c}").alias(c) for c in out])


def reached(starts: DataFrame, links: DataFrame, keys: Sequence[str], at: str, to: str) -> DataFrame:
    """All places (keys, ``at``) that the links lead to from the starts, the starts among them.

    A place has at most one link, and links only lead on. Round k knows the places up to
    2**k - 1 links away and the links of 2**k steps, so a path of n links takes log2(n) rounds.
    """
    keys = list(keys)
    found = stored(starts.select(*keys, at).distinct(), "reached")
    jump = stored(links.where(F.col(to).isNotNull()).select(*keys, at, to), "jumps")
    while not jump.isEmpty():
        further = found.join(jump, [*keys, at]).select(*keys, F.col(to).alias(at))
        found = stored(found.unionByName(further).distinct(), "reached")
        onward = jump.select(*keys, F.col(at).alias(to), F.col(to).alias("_then"))
        jump = stored(jump.join(onward, [*keys, to]).select(*keys, at, F.col("_then").alias(to)), "jumps")
    return found


def thin_by_gap(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int) -> DataFrame:
    """Keep a row when it lies at least ``gap_seconds`` after the last kept one of its key.

    The rule looks at the last *kept* row. Each row's link leads to the first row at least
    the gap later: that one is kept if this one is. A row without another in the gap before
    it is kept whatever came before; the others are kept if such a row's links reach them.
    Where all rows lie apart no link is followed. Of rows at one time the key keeps one.
    """
    keys = list(keys)
    gap = int(gap_seconds) * 1_000_000
    # Keys may be null; as one text they join like any other.
    of = F.to_json(F.struct(*keys)) if keys else F.lit("")
    named = stored(df.withColumns({"_of": of, "_us": micros(ts)}), "thin-rows")
    places = named.select("_of", "_us").distinct()
    asked = places.select("_of", F.explode(F.array(F.struct((F.col("_us") + gap).alias("a"), F.lit(True).alias("ahead")), F.struct((F.col("_us") - gap + 1).alias("a"), F.lit(False).alias("ahead")))).alias("_q"), F.col("_us").alias("_own"))
    told = stored(first_at_or_after(places, asked.select("_of", F.col("_q.a").alias("_us"), F.col("_q.ahead").alias("_ahead"), "_own"), ["_of"], "_us", "_next"), "thin-links")
    starts = told.where(~F.col("_ahead") & (F.col("_next") == F.col("_own"))).select("_of", F.col("_own").alias("_us"))
    links = told.where(F.col("_ahead") & F.col("_next").isNotNull()).select("_of", F.col("_own").alias("_us"), F.col("_next").alias("_to"))
    # A link to a row that is kept anyway says nothing.
    links = links.join(starts.select("_of", F.col("_us").alias("_to")), ["_of", "_to"], "left_anti")
    kept = reached(starts, links, ["_of"], "_us", "_to")
    one = F.row_number().over(Window.partitionBy("_of", "_us").orderBy(*[F.hash(*df.columns), *[F.to_json(F.struct(*df.columns))]]))
    return named.join(kept, ["_of", "_us"]).withColumn("_one", one).where("_one = 1").select(*df.columns)
