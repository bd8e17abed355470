"""Upkeep of derived tables: what is due, in which order, what is kept or dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions.text import clamp_label
from offerlens.operators.cards import card_order, offer_positions

SHORTLIST, TTL_DAYS, WARM_LIMIT = 60, 7, 120


def shortlist(cards: DataFrame, most: int = SHORTLIST, key: str = "spec_key") -> DataFrame:
    """The best corroborated cards with their place."""
    w = Window.orderBy(F.desc("source_count"), F.desc("offer_count"), F.asc(key))
    top = card_order(cards, key).limit(most)
    return top.select(key, F.row_number().over(w).alias("place"))


def due_details(cards: DataFrame, offers: DataFrame, stored: DataFrame, now: Column, most: int = SHORTLIST, ttl_days: int = TTL_DAYS, key: str = "spec_key", enabled: Sequence[str] | None = None) -> DataFrame:
    """Offers of shortlisted cards whose detail is missing, undated or old, in fetch order.

    First every card's first offer, then every second; inside a round the sources
    take turns, in the order they first appear. Positions count all offers of a
    card and are computed without gathering one card's offers. ``enabled`` names the
    sources that may be fetched; offers of others keep their position but are not planned.
    """
    top = shortlist(cards, most, key)
    placed = offer_positions(offers.join(top, key), key)
    held = stored.select("source", "source_id", F.col("fetched_at").alias("_at"))
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("_at").cast("timestamp"))
    due = placed.join(held, ["source", "source_id"], "left").where(F.coalesce(age >= ttl_days * 86400, F.lit(True)))
    if enabled is not None:
        due = due.where(F.col("source").isin(*enabled))
    in_round = Window.partitionBy("position", "source")
    turn = due.withColumn("turn", F.row_number().over(in_round.orderBy("place")) - 1).withColumn("_first", F.min("place").over(in_round))
    return turn.select(key, "source", "source_id", "position", "turn", "place", "_first").orderBy("position", "turn", "_first").drop("_first")


def live_offers(offers: DataFrame) -> DataFrame:
    return offers.select("source", "source_id").where(F.col("source").isNotNull() & F.col("source_id").isNotNull()).distinct()


def merge_details(stored: DataFrame, fresh: DataFrame, offers: DataFrame) -> DataFrame:
    """Fresh details over stored ones, without listings that left the index.

    When offers exist but none can be addressed the index is damaged, so stored
    details are all kept.
    """
    keys = ["source", "source_id"]
    live = live_offers(offers)
    damaged = offers.agg((F.count(F.lit(1)) > 0) & (F.count_if(F.col("source").isNotNull() & F.col("source_id").isNotNull()) == 0)).scalar()
    marked = stored.join(live.withColumn("_live", F.lit(True)), keys, "left")
    kept = marked.where(F.coalesce("_live", F.lit(False)) | damaged).drop("_live")
    return fresh.unionByName(kept.join(fresh.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def fingerprint(version: str = "") -> Column:
    """What makes a card's stored text stale: its figures or the rules that checked it."""
    return F.concat_ws(":", "median_price", "offer_count", "min_price", "max_price", F.lit(version))


def warm_plan(cards: DataFrame, stored: DataFrame, version: str, most: int = WARM_LIMIT, key: str = "spec_key") -> DataFrame:
    """Each known key as reused, to_generate, carried or expired."""
    now = cards.select(key, fingerprint(version).alias("_now"))
    top = shortlist(cards, most, key).select(key, F.lit(True).alias("_top"))
    prior = stored.select(key, F.col("fingerprint").alias("_was"))
    joined = now.join(top, key, "left").join(prior, key, "full")
    same = F.coalesce(F.col("_now") == F.col("_was"), F.lit(False))
    status = (
        F.when(F.col("_top") & same, "reused").when(F.col("_top"), "to_generate").when(F.col("_was").isNotNull() & same, "carried")
        .when(F.col("_was").isNotNull(), "expired")
    )
    return joined.select(key, status.alias("status")).where(F.col("status").isNotNull())


def warmed(plan: DataFrame, generated: DataFrame, key: str = "spec_key") -> DataFrame:
    """The plan after a run: what was to be generated is now generated or failed."""
    made = generated.select(key).distinct().withColumn("_made", F.lit(True))
    joined = plan.join(made, key, "left")
    done = F.when(F.col("status") != "to_generate", F.col("status")).when(F.col("_made"), "generated").otherwise("failed")
    return joined.withColumn("status", done).drop("_made")


def coverage(outcome: DataFrame) -> DataFrame:
    """Keys per status; statuses that no key has are listed with 0."""
    names = ("reused", "generated", "failed", "carried", "expired")
    counted = outcome.agg(*[F.count_if(F.col("status") == n).alias(n) for n in names])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("status"), F.col(n).alias("n")) for n in names])).alias("r")).select("r.*")


def refreshed(stored: DataFrame, generated: DataFrame, plan: DataFrame, key: str = "spec_key") -> DataFrame:
    """Stored texts after a run: generated ones plus those still valid."""
    kept = plan.where(F.col("status").isin("reused", "carried")).select(key)
    valid = stored.join(kept, key, "left_semi")
    return generated.unionByName(valid.join(generated.select(key), key, "left_anti"))


def quarantine(rows: DataFrame, sound: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows and rows set aside; a NULL verdict counts as unsound."""
    ok = F.coalesce(sound, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def relabel(rows: DataFrame, column: str, default: str = "landing") -> DataFrame:
    """Replace labels that cannot be printed; usable ones stay."""
    return rows.withColumn(column, clamp_label(F.col(column), default))
