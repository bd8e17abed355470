"""Removal of repeated line runs with a suffix array over line ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.plans.store import stored

# A line counts when it has a character that is not one of the six separators.
SOLID = r"[^\x20\x09-\x0D]"
DOC = ["_id", "_h"]
ADDED = ("_n_lines", "_n_removed", "_runs", "_copies")
# The interval of all suffixes, before any line is compared; no suffix is its first one.
ALL = -1


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _ranked(suffixes: DataFrame, name: str) -> DataFrame:
    """Order-preserving ranks of the pairs (_a, _b) that occur more than once.

    Pairs are counted first, so the sort sees each pair once. The sort is global: a range
    shuffle on both columns, then the row number with its partition as the high digits.
    Suffixes whose pair is unique have their final place already and leave.
    """
    pairs = suffixes.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_a", "_b")
    ranks = stored(pairs.orderBy("_a", "_b").withColumn("_rank", F.monotonically_increasing_id()), name)
    return suffixes.join(ranks, ["_a", "_b"]).drop("_a", "_b")


def _suffixes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every visible line as the start of a suffix: its place ``_p``, the end of its document
    in places, the line's number ``_i`` and hash ``_a``.

    Places are consecutive in a document and follow id, then content, then the line.
    """
    lines = F.transform(_lines(F.col(text_col)), lambda line, i: F.struct(i.alias("i"), F.xxhash64(line).alias("l"), line.rlike(SOLID).alias("solid")))
    solid = F.filter(lines, lambda x: x["solid"])
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_h"),
        F.transform(solid, lambda x: F.struct(x["i"].alias("i"), x["l"].alias("l"))).alias("_x"),
    )
    rows = rows.where(F.size("_x") > 0).groupBy(*DOC).agg(F.first("_x").alias("_x"))
    # The number is given behind the sort and the split: it counts on within a document.
    placed = rows.orderBy(*DOC).select(*DOC, F.size("_x").alias("_size"), F.posexplode("_x").alias("_j", "_y"))
    placed = placed.withColumn("_p", F.monotonically_increasing_id())
    return placed.select(
        "_p", (F.col("_p") - F.col("_j") + F.col("_size")).alias("_end"), *DOC,
        F.col("_y.i").alias("_i"), F.col("_y.l").alias("_a"), F.lit(0).cast("bigint").alias("_b"),
    )


def _doubled(suffixes: DataFrame) -> list[DataFrame]:
    """Ranks of all suffixes by their first 1, 2, 4, ... lines, until no two are equal.

    A level holds the suffixes that have an equal one at its length.
    """
    levels = [stored(_ranked(suffixes, "line-ranks-1"), "line-suffixes-1")]
    while True:
        width = 2 ** len(levels)
        # The suffix half a width on; a missing one was unique, and so is this one then.
        ahead = levels[-1].select((F.col("_p") - width // 2).alias("_p"), F.col("_rank").alias("_b"))
        last = levels[-1].where(F.col("_p") + width <= F.col("_end")).select("_p", "_end", F.col("_rank").alias("_a"))
        longer = stored(_ranked(last.join(ahead, "_p"), f"line-ranks-{width}"), f"line-suffixes-{width}")
        if longer.isEmpty():
            return levels
        levels.append(longer)


def _intervals(levels: list[DataFrame]) -> DataFrame:
    """The intervals of the suffix array by longest common prefix, as a tree of edges.

    An edge ``_p, _end, _v, _m`` hangs a suffix, or an interval with the first suffix ``_p``,
    below the interval whose first suffix is ``_v`` and whose suffixes have exactly ``_m``
    lines in common, or more if it has one edge. From the largest width down, the edges of an
    interval that agree on ``width`` lines behind its prefix become an interval of their own,
    so every length is settled bit by bit. An edge looks at one rank a width, and a group at
    its edges, not at all suffixes below them.
    """
    edges = None
    for k in reversed(range(len(levels))):
        width, level = 2 ** k, levels[k].select("_p", "_end", "_rank")
        fresh = level if edges is None else level.join(levels[k + 1].select("_p"), "_p", "left_anti")
        asked = fresh.select("_p", "_end", F.lit(ALL).cast("bigint").alias("_v"), F.lit(0).cast("bigint").alias("_m"), "_rank")
        if edges is not None:
            # Edges without a rank get numbers that nothing equals: as NULL they would meet in one task.
            alone = -1 - F.col("_p")
            behind = F.col("_p") + F.col("_m")
            old = edges.withColumn("_q", F.when(behind + width <= F.col("_end"), behind).otherwise(alone))
            old = old.join(level.select(F.col("_p").alias("_q"), "_rank"), "_q", "left")
            asked = asked.unionByName(old.select("_p", "_end", "_v", "_m", F.coalesce("_rank", alone).alias("_rank")))
        asked = stored(asked, f"line-edges-{width}")
        groups = asked.groupBy("_v", "_m", "_rank").agg(F.count(F.lit(1)).alias("_n"), F.min("_p").alias("_first")).where("_n > 1").drop("_n")
        first = F.col("_first")
        stays = F.struct("_p", "_end", "_v", "_m")
        below = F.struct("_p", "_end", first.alias("_v"), (F.col("_m") + width).alias("_m"))
        # The first edge of a new interval stands for the interval as well.
        edge = F.when(first.isNull(), F.array(stays)).when(F.col("_p") == first, F.array(below, stays)).otherwise(F.array(below))
        edges = asked.join(groups, ["_v", "_m", "_rank"], "left").select(F.explode(edge).alias("_e")).select("_e.*")
    return edges


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 1) -> DataFrame:
    """Later copies of repeated line runs, lines from 0: ``_id``, ``_h``, ``copies`` and ``runs``.

    ``copies`` [(start, length)] are the maximal runs of at least ``min_lines`` visible lines
    that also start at an earlier place (by id, then content, then line): none can be longer
    to either side. They may overlap; ``length`` counts visible lines. ``runs`` [(start,
    length)] are the stretches of lines that they cover.

    Lines without a visible character are left out of the sequences. Prefix doubling ranks all
    suffixes until no two are equal; the ranks give the intervals of the suffix array with
    their exact longest common prefixes. A suffix that is not the first of an interval, but of
    all intervals below it, has an earlier copy of just that prefix and of no longer one.
    """
    levels = _doubled(stored(_suffixes(docs, id_col, text_col), "line-suffixes"))
    found = _intervals(levels).where((F.col("_p") != F.col("_v")) & (F.col("_m") > 0)).select("_p", "_m")
    found = found.join(levels[0].select("_p", "_end", *DOC, "_i"), "_p")
    ordered = Window.partitionBy("_end").orderBy("_p")
    long_enough = F.col("_m") >= int(min_lines)
    reach = F.max(F.when(long_enough, F.col("_p") + F.col("_m"))).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = (F.lag("_p").over(ordered) == F.col("_p") - 1) & (F.lag("_m").over(ordered) == F.col("_m") + 1)
    told = found.select("_end", *DOC, "_p", "_i", "_m", reach.alias("_reach"), (long_enough & ~F.coalesce(inside, F.lit(False))).alias("_maximal"))
    gone = told.where("_reach > _p").withColumn("_island", F.col("_i") - F.row_number().over(ordered))
    copy = F.when(F.col("_maximal"), F.struct(F.col("_i").alias("start"), F.col("_m").cast("int").alias("length")))
    islands = gone.groupBy("_end", *DOC, "_island").agg(F.min("_i").alias("start"), F.count(F.lit(1)).cast("int").alias("length"), F.collect_list(copy).alias("_copies"))
    return islands.groupBy("_end", *DOC).agg(
        F.sort_array(F.collect_list(F.struct("start", "length"))).alias("runs"), F.sort_array(F.flatten(F.collect_list("_copies"))).alias("copies"),
    ).drop("_end")


def without_runs(text: Column, runs: Column) -> Column:
    """The text less the lines of ``runs``: the stretches between them are joined again."""
    lines = _lines(text)
    edges = F.concat(
        F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("length"))),
        F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"))),
    )
    stops = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.size(lines)))
    kept = F.flatten(F.transform(
        edges, lambda e, k: F.slice(lines, e["start"] + e["length"] + 1, F.element_at(stops, k + 1) - e["start"] - e["length"])
    ))
    return F.array_join(kept, "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 1) -> DataFrame:
    """The documents with later copies of repeated line runs deleted.

    Adds ``_n_lines``, ``_n_removed``, ``_runs``, ``_copies`` to the given columns and replaces
    the text; the last two are ``runs`` and ``copies`` of :func:`repeated_runs`.
    A run of at least ``min_lines`` visible lines in a row that stands earlier, in an
    earlier document or further up in the same one, is deleted with overlapping copies
    allowed; the first copy stays, and so do lines without a visible character. Documents
    are ordered by id (null first), then by a hash of the text. Rows with equal id and
    text are one document: each gets the same verdict. A null text stays null with no
    lines; an empty table gives an empty result; other columns pass through, but for
    ones named like the four added.
    """
    runs = repeated_runs(docs, id_col, text_col, min_lines)
    runs = runs.select(F.xxhash64("_id", "_h").alias("_key"), F.col("_h").alias("_hash"), F.col("runs").alias("_runs"), F.col("copies").alias("_copies"))
    # The given columns travel as one struct: their names cannot meet those used here.
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"), F.col(id_col).alias("_id"))
    whole = whole.withColumn("_key", F.xxhash64("_id", "_hash"))
    joined = whole.join(runs, ["_key", "_hash"], "left")
    n_lines = F.when(F.col("_text").isNull(), F.lit(0)).otherwise(F.size(_lines(F.col("_text"))))
    removed = F.aggregate(F.col("_runs"), F.lit(0), lambda a, r: a + r["length"])
    new_text = F.when(F.col("_runs").isNull(), F.col("_text")).otherwise(without_runs(F.col("_text"), F.col("_runs")))
    given = [new_text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns if c not in ADDED]
    return joined.select(*given, n_lines.cast("bigint").alias("_n_lines"), F.coalesce(removed, F.lit(0)).cast("bigint").alias("_n_removed"), "_runs", "_copies")
