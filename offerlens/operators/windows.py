"""Sessions and overlapping windows over events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.operators.sequences import first_at_or_after, micros, running_total
from offerlens.plans.store import stored


def sessions(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int, **measures: Column) -> DataFrame:
    """Runs of a key's events with less than the gap between neighbours.

    One row per session: the keys, ``session_start``, ``session_end`` (the gap after the
    last event), ``events``, and ``measures``: an alias each for a sum of a whole-number
    column. Events are added up per moment first. A moment without another in the gap
    before it opens a session, and the number of openings so far numbers it; both are found
    on the tree of time cells, so a key with most of the events is spread like any other.
    Events without a time are left out; keys may be null.
    """
    keys, gap = list(keys), int(gap_seconds) * 1_000_000
    named = df.where(F.col(ts).isNotNull()).withColumns({"_of": F.to_json(F.struct(*keys)), "_us": micros(ts)})
    moments = named.groupBy("_of", "_us").agg(
        *[F.first(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.count(F.lit(1)).alias("events"), *[F.sum(c).alias(name) for name, c in measures.items()]
    )
    moments = stored(moments, "moments")
    places = moments.select("_of", "_us")
    told = first_at_or_after(places, places.select("_of", (F.col("_us") - gap + 1).alias("_us"), F.col("_us").alias("_own")), ["_of"], "_us", "_next")
    opens = told.select("_of", F.col("_own").alias("_us"), (F.col("_next") == F.col("_own")).alias("_opens"))
    numbered = running_total(
        moments.join(opens, ["_of", "_us"]).withColumn("_at", F.timestamp_micros("_us")), ["_of"], "_at", [], F.col("_opens").cast("int"), "_session"
    )
    found = numbered.groupBy("_of", "_session").agg(
        *[F.first(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.min("_at").alias("session_start"), F.timestamp_micros(F.max("_us") + gap).alias("session_end"),
        F.sum("events").alias("events"), *[F.sum(name).alias(name) for name in measures],
    )
    return found.drop("_of", "_session")


def sliding(df: DataFrame, keys: Sequence[str], ts: str, size_seconds: int, slide_seconds: int, **measures: Column) -> DataFrame:
    """Events per key and overlapping window (``window_start``), windows without events left out.

    Events are added up per slide first; a slide's sums then go to the windows that hold it.
    The size is a multiple of the slide, and windows start at multiples of it.
    """
    if size_seconds % slide_seconds:
        raise ValueError("the size must be a multiple of the slide")
    cell = F.floor(micros(ts) / (slide_seconds * 1_000_000)).cast("bigint")
    cells = df.where(F.col(ts).isNotNull()).groupBy(*keys, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("events"), *[F.sum(c).alias(n) for n, c in measures.items()])
    held = F.sequence(F.col("_cell") - (size_seconds // slide_seconds - 1), F.col("_cell"))
    spread = cells.withColumn("_start", F.explode(held))
    summed = spread.groupBy(*keys, "_start").agg(F.sum("events").alias("events"), *[F.sum(n).alias(n) for n in measures])
    return summed.withColumn("window_start", F.timestamp_seconds(F.col("_start") * slide_seconds)).drop("_start")
