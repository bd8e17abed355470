"""From one listing to the rest of the market for the same car."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.functions.urls import HOSTS, listing_identity
from offerlens.operators.scale import offsets, top_per_group

NO_MOVE = 1_000_000


def reverse_lookup(offers: DataFrame, urls: DataFrame, url: str = "url", key: str = "spec_key", hosts: dict[str, str] = HOSTS) -> DataFrame:
    """Each pasted URL with its card, the cheapest other clean offer and the overpay.

    ``status`` is ``found``, ``unknown_url`` or ``not_in_index``. A card answers
    from its two cheapest clean offers, so no offer is paired with its siblings.
    """
    pasted = urls.withColumn("_id", listing_identity(F.col(url), hosts))
    pasted = pasted.withColumn("source", F.col("_id.source")).withColumn("source_id", F.col("_id.source_id")).drop("_id")
    mine = offers.select("source", "source_id", key, F.col("price").alias("price"))
    found = pasted.join(mine, ["source", "source_id"], "left")
    clean = offers.where(F.size("flags") == 0).select(key, "price", "source", "source_id")
    two = top_per_group(clean, [key], [F.asc("price"), F.asc("source"), F.asc("source_id")], 2)
    two = two.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "price", "source", "source_id"))).alias("_two"))
    spread = offers.select(key, "source").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_sources"))
    joined = found.join(two, key, "left").join(spread, key, "left")
    other = F.filter("_two", lambda o: (o["source"] != F.col("source")) | (o["source_id"] != F.col("source_id")))
    joined = joined.withColumn("_other", F.get(other, F.lit(0)))
    over = F.col("price") - F.col("_other.price")
    status = F.when(F.col("source").isNull(), "unknown_url").when(F.col(key).isNull(), "not_in_index").otherwise("found")
    return joined.select(
        url, status.alias("status"), "source", "source_id", key, "price",
        F.col("_other.price").alias("cheapest_price"), F.col("_other.source").alias("cheapest_source"),
        F.col("_other.source_id").alias("cheapest_id"),
        F.when(over > 0, over * 100.0 / F.col("_other.price")).alias("overpay_pct"),
        (F.col("_sources") - 1).alias("other_sources"),
        F.when(F.col("_sources") == 1, F.lit("only")).alias("note"),
    )


def cheaper_offers(anchors: DataFrame, offers: DataFrame, shown: int = 4, key: str = "spec_key") -> DataFrame:
    """The first cheaper offers of the same card and how many there are in all.

    ``anchors`` holds ``key, source, source_id, price``. The cheapest few of a card
    serve every anchor in it; the count comes from the card's price ladder.
    """
    banded = offers.withColumn("_band", F.shiftright("price", 20))
    below = offsets(banded.select(key, "_band", "price"), [key], ["_band", "price"])
    few = top_per_group(
        offers.select(key, "price", "source", "source_id"), [key], [F.asc("price"), F.asc("source"), F.asc("source_id")], shown
    )
    few = few.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "price", "source", "source_id"))).alias("_few"))
    held = anchors.withColumn("_band", F.shiftright("price", 20)).join(below, [key, "_band", "price"]).join(few, key)
    cheaper = F.filter("_few", lambda o: o["price"] < F.col("price"))
    return held.select(
        key, "source", "source_id", "price", F.col("_offset").alias("cheaper_count"),
        F.array_join(F.transform(cheaper, lambda o: F.concat_ws(":", o["source"], o["source_id"])), ",").alias("cheaper"),
    )


def saved_deltas(saved: DataFrame, cards: DataFrame, key: str = "spec_key") -> DataFrame:
    """Saved cards against today's medians; small moves and unquoted medians are NULL."""
    now = cards.select(key, "median_price", "median_reliable", F.lit(True).alias("_live"))
    joined = saved.join(now, key, "left")
    quoted = F.when(F.col("median_reliable"), F.col("median_price"))
    diff = quoted - F.col("saved_median")
    told = (F.col("saved_median") > 0) & (F.abs(diff) >= NO_MOVE)
    return joined.select(
        *saved.columns, F.when(F.col("_live"), "live").otherwise("gone").alias("state"), quoted.alias("median_now"),
        F.when(told, diff).alias("diff"), F.when(told, diff * 100.0 / F.col("saved_median")).alias("diff_pct"),
    )


def recent_saved(saves: DataFrame, user: str, key: str, at: str, most: int = 60) -> DataFrame:
    """A user's saved keys, newest first, each once, at most ``most``."""
    newest = saves.groupBy(user, key).agg(F.max(at).alias(at))
    return top_per_group(newest, [user], [F.desc(at), F.asc(key)], most)


FOUND, EMPTY, NOT_FOUND = "found", "empty", "not_found"


def point_lookup(asked: DataFrame, known: DataFrame, values: DataFrame, key: str = "spec_key") -> DataFrame:
    """Each asked key with its answer, for many keys at once.

    ``not_found`` when ``known`` lacks the key, ``empty`` when it is known but ``values`` has
    no row for it, else ``found`` with the values' columns; a key with several value rows
    gives several rows. Pass cards as both ``known`` and ``values`` to look up cards.
    """
    keys = known.select(key).distinct().withColumn("_known", F.lit(True))
    held = values.withColumn("_held", F.lit(True))
    joined = asked.join(keys, key, "left").join(held, key, "left")
    answer = F.when(F.col("_known").isNull(), NOT_FOUND).when(F.col("_held").isNull(), EMPTY).otherwise(FOUND)
    shown = [F.when(F.col("_known").isNotNull(), F.col(c)).alias(c) for c in values.columns if c != key]
    return joined.select(*asked.columns, answer.alias("answer"), *shown)


def detail_lookup(asked: DataFrame, details: DataFrame, sources: Sequence[str], empty: Column) -> DataFrame:
    """Details of asked listings (``source, source_id``); found or not found.

    An unknown source, a missing id, a listing without details and one whose details are
    only a note that nothing was found (``empty``) are all the same miss.
    """
    keys = ["source", "source_id"]
    held = details.where(~F.coalesce(empty, F.lit(False))).withColumn("_held", F.lit(True))
    joined = asked.join(held, keys, "left")
    hit = F.col("_held").isNotNull() & F.col("source").isin(*sources) & (F.coalesce("source_id", F.lit("")) != "")
    shown = [F.when(hit, F.col(c)).alias(c) for c in details.columns if c not in keys]
    return joined.select(*asked.columns, F.when(hit, FOUND).otherwise(NOT_FOUND).alias("answer"), *shown)
