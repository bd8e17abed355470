"""Price history: append per cycle, replay of many cycles, retirement, chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.operators.scale import top_per_group
from offerlens.operators.sequences import thin_by_gap

MAX_POINTS, MIN_GAP_SECONDS, RETIRE_AFTER_DAYS = 240, 600, 60


def append_points(history: DataFrame, cards: DataFrame, built_at: Column, now: Column, key: str = "spec_key", gap_seconds: int = MIN_GAP_SECONDS, most: int = MAX_POINTS) -> DataFrame:
    """``spec_key, t, median, n`` with this cycle's quoted medians added.

    The same index twice, or a cycle too soon after the last point, adds nothing.
    """
    last = history.groupBy(key).agg(F.max("t").alias("_last"))
    quoted = cards.where(F.col("median_reliable") & (F.col("median_price") > 0))
    fresh = quoted.join(last, key, "left").withColumn("_t", built_at.cast("timestamp"))
    elapsed = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("_last").cast("timestamp"))
    due = F.col("_last").isNull() | ((F.col("_last").cast("timestamp") != F.col("_t")) & (elapsed >= gap_seconds))
    points = fresh.where(due).select(
        key, F.col("_t").cast(history.schema["t"].dataType).alias("t"),
        F.col("median_price").alias("median"), F.col("offer_count").cast(history.schema["n"].dataType).alias("n"),
    )
    return newest_points(history.unionByName(points), key, most)


def newest_points(points: DataFrame, key: str = "spec_key", most: int = MAX_POINTS) -> DataFrame:
    return top_per_group(points, [key], [F.desc("t")], most).drop("rank")


def replay(points: DataFrame, key: str = "spec_key", gap_seconds: int = MIN_GAP_SECONDS, most: int = MAX_POINTS, reliable: int = 3) -> DataFrame:
    """The stored history after many cycles, from one candidate point per key and cycle."""
    return newest_points(thin_by_gap(points.where(F.col("n") >= reliable), [key], "t", gap_seconds), key, most)


def retire(history: DataFrame, live: DataFrame, now: Column, key: str = "spec_key", days: int = RETIRE_AFTER_DAYS) -> DataFrame:
    """Drop keys that left the index and whose newest point is old or undated."""
    last = history.groupBy(key).agg(F.max("t").alias("_last"))
    age = F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("_last").cast("timestamp"))) / 86400)
    old = last.where(F.coalesce(age >= days, F.lit(True)))
    gone = old.join(live.select(key).distinct(), key, "left_anti").select(key)
    return history.join(gone, key, "left_anti")


def chart(history: DataFrame, key: str = "spec_key") -> DataFrame:
    """Chart coordinates in a 0..100 box: time runs right to left, flat series centred."""
    ends = history.groupBy(key).agg(
        F.min("median").alias("_lo"), F.max("median").alias("_hi"), F.min("t").alias("_t0"), F.max("t").alias("_t1")
    )
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    joined = history.join(ends, key)
    span, rise = us("_t1") - us("_t0"), F.col("_hi") - F.col("_lo")
    progress = F.when(span > 0, (us("t") - us("_t0")) / F.when(span > 0, span)).otherwise(0.5)
    y = F.when(rise > 0, 8 + (1 - (F.col("median") - F.col("_lo")) / F.when(rise > 0, rise)) * 84).otherwise(50.0)
    return joined.select(key, "t", F.round(100 - progress * 100, 2).alias("x"), F.round(y, 2).alias("y"))
