"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.cells import hash_cell, running_sum
from offerlens.plans.store import stored

# Words are runs of anything but these six separators.
WORD = r"[^\x20\x09-\x0D]+"
NULL_SOURCE = "z"


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, cycle: Sequence[float], budget: float, cap: float) -> DataFrame:
    """Adds ``target`` to one row per source (``_src``, ``source_size``).

    Weights go round ``cycle`` in the order of ``_src``. Together the targets make
    ``budget`` times all sizes; none is above ``cap`` times its source's size, and what a
    capped source leaves is shared by weight among the others. Sources are filled in the
    order of the share at which they reach their cap, so running sums give the fill level.
    The windows hold one row per source.
    """
    everything = Window.orderBy("_src")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    ranked = sizes.withColumn("_w", F.element_at(weights, (F.row_number().over(everything) - 1) % len(cycle) + 1))
    ranked = ranked.withColumn("_most", F.col("source_size") * float(cap)).withColumn("_ratio", F.col("_most") / F.col("_w"))
    alone = Window.partitionBy()
    by_ratio = Window.orderBy("_ratio", "_src")
    ranked = ranked.withColumn("_budget", F.sum("source_size").over(alone) * float(budget))
    ranked = ranked.withColumn("_full", F.sum("_most").over(by_ratio) - F.col("_most"))
    ranked = ranked.withColumn("_rest", F.sum("_w").over(alone) - F.sum("_w").over(by_ratio) + F.col("_w"))
    ranked = ranked.withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_rest"))
    # The level is set by the first source that does not reach its cap.
    level = F.min_by(F.when(F.col("_ratio") > F.col("_level"), F.col("_level")), F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_src")))
    ranked = ranked.withColumn("_fill", level.over(alone))
    target = F.when(F.col("_fill").isNull(), F.col("_most")).otherwise(F.least("_most", F.col("_w") * F.col("_fill")))
    return ranked.select("_src", "source_size", target.alias("target"), F.floor("_budget").cast("bigint").alias("_budget"))


def weighted_fair_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    cycle: Sequence[float] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: int = 17,
) -> DataFrame:
    """Words that the mix takes from each document.

    Every source is a queue of its documents in the order of a seeded hash, gone through
    again while its target asks for it. An entry's virtual finish time is the words of its
    source up to its end, divided by the source's target. All entries are ordered by that
    time over a fixed grid of time cells, and the order is cut where the words reach the
    budget; the entry at the cut is taken in part.

    Returns id, ``source``, ``size``, ``source_size``, ``target``, ``taken``, ``passes``
    (entries taken whole), ``text_hash``, one row per input row. A null or wordless text has size 0 and
    ``taken`` 0; a null source is a source of its own, after all others; repeated rows are
    entries of their own; an empty table gives an empty result. Other columns are ignored.
    """
    src = F.coalesce(F.concat(F.lit("a"), F.col(source_col)), F.lit(NULL_SOURCE))
    base = docs.select(
        F.col(id_col).alias("_id"), src.alias("_src"), word_count(F.col(text_col)).alias("_size"),
        F.xxhash64(text_col).alias("_h"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("_o"),
    )
    base = stored(base, "mix-sizes")
    sizes = base.groupBy("_src").agg(F.sum("_size").alias("source_size"))
    sources = stored(source_targets(sizes, cycle, budget, cap), "mix-sources")
    entries = base.where("_size > 0").withColumn("_cell", hash_cell(F.col("_o")))
    entries = running_sum(entries, ["_src"], "_cell", ["_o", "_id", "_size"], "_size", "_start").drop("_cell")
    entries = entries.join(sources, "_src").withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(max(1, -int(-cap // 1)) - 1))))
    finish = (F.col("_pass") * F.col("source_size") + F.col("_start") + F.col("_size")) / F.col("target")
    entries = entries.withColumn("_finish", finish).withColumn("_cell", F.floor(F.col("_finish") * 2**20).cast("bigint"))
    placed = running_sum(entries.drop("source_size", "target"), [], "_cell", ["_finish", "_src", "_start"], "_size", "_before")
    take = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_budget") - F.col("_before"))).cast("bigint")
    placed = placed.withColumn("_take", take)
    # (source, start) names an entry: starts inside a source are all different.
    mixed = placed.groupBy("_src", "_start", "_id", "_h", "_size").agg(
        F.sum("_take").alias("taken"), F.count(F.when(F.col("_take") == F.col("_size"), 1)).alias("passes")
    )
    mixed = mixed.select("_src", "_id", "_h", "_size", "taken", "passes")
    nothing = base.where("_size = 0").select("_src", "_id", "_h", "_size", F.lit(0).cast("bigint").alias("taken"), F.lit(0).cast("bigint").alias("passes"))
    whole = mixed.unionByName(nothing).join(sources.drop("_budget"), "_src")
    source = F.when(F.col("_src") != NULL_SOURCE, F.expr("substring(_src, 2)"))
    return whole.select(
        F.col("_id").alias(id_col), source.alias("source"), F.col("_size").alias("size"), "source_size", "target", "taken", "passes", F.col("_h").alias("text_hash")
    )
