"""Offers to cards: one row per entity key with robust price statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.numbers import signed_pct
from offerlens.operators.flags import outlier_flag
from offerlens.operators.scale import exact_median, latest, order_statistics, positions, top_per_group
from offerlens.plans.store import stored

MIN_COHORT = 3
# An outlier is under 2/5 or over 5/2 of the median, in whole numbers.
OUTLIER_PARTS = (2, 5)


def latest_captures(captures: DataFrame, order: Sequence[Column], keys: Sequence[str] = ("source_id", "source")) -> DataFrame:
    """Collapse re-captures of one listing before anything counts them."""
    return latest(captures, list(keys), order)


def unseen(captures: DataFrame, stored: DataFrame, keys: Sequence[str] = ("source", "source_id", "content_hash")) -> DataFrame:
    """Captures whose content is not stored yet, one per content."""
    keys = list(keys)
    return captures.dropDuplicates(keys).join(stored.select(*keys).distinct(), keys, "left_anti")


def is_outlier(price: Column, median: Column, n: Column) -> Column:
    """Ratio below 0.4 or above 2.5 of the median, in cohorts of three and more."""
    few, many = OUTLIER_PARTS
    return (n >= MIN_COHORT) & ((price * many < median * few) | (price * few > median * many))


def price_ladder(offers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of equal ``keys`` and price counted together: all that price statistics need.

    Only whole numbers are aggregated, so tasks hash their rows and sort none.
    """
    flags = F.size("flags")
    pictured = _image(offers).isNotNull()
    return offers.groupBy(*keys, "price").agg(
        F.count(F.lit(1)).alias("rung"),
        F.sum(F.when(flags == 0, 1).otherwise(0)).alias("rung_clean"),
        F.sum(flags).cast("bigint").alias("rung_flags"),
        F.sum(F.when(pictured, 1).otherwise(0)).alias("rung_images"),
    )


def _image(offers: DataFrame) -> Column:
    return F.nullif(F.col("image"), F.lit("")) if "image" in offers.columns else F.lit(None).cast("string")


def first_images(offers: DataFrame, rungs: DataFrame, key: str) -> DataFrame:
    """The image of each key's first pictured offer by price, source and id (nulls first).

    The price and source are found on the counts; only offers of these are compared.
    """
    shown = rungs.where("rung_images > 0").groupBy(key, "source").agg(
        F.min("price").alias("price"), F.count_if(F.col("price").isNull()).alias("_unpriced")
    )
    at = F.struct(F.when(F.col("_unpriced") == 0, F.col("price")).alias("price"), "source")
    picks = shown.groupBy(key).agg(F.min(at).alias("_at")).select(F.col(key).alias("_key"), F.col("_at.price").alias("_price"), F.col("_at.source").alias("_source"))
    pictured = offers.select(key, "price", "source", "source_id", _image(offers).alias("image")).where(F.col("image").isNotNull())
    same = (F.col(key) == F.col("_key")) & F.col("price").eqNullSafe(F.col("_price")) & F.col("source").eqNullSafe(F.col("_source"))
    first = F.min(F.struct("source_id", "image"))["image"]
    return pictured.join(picks, same).groupBy(key).agg(first.alias("image"))


def medians(offers: DataFrame, key: str = "spec_key") -> DataFrame:
    return exact_median(offers, [key], "price", out="median_price")


def with_deviation(offers: DataFrame, key: str = "spec_key", middle: DataFrame | None = None) -> DataFrame:
    """Each offer with its distance to the median and the cohort finding added.

    ``middle`` is the written table of ``medians``, if the caller has it. It has a row a key: its size
    is known before the join, and where it is small no offer is shuffled. Else the join on the key
    is the only row-level shuffle, which adaptive execution splits when one key is hot.
    """
    joined = offers.join(stored(medians(offers, key), "medians") if middle is None else middle, key)
    price, median = F.col("price"), F.col("median_price")
    flagged = F.when(
        is_outlier(price, median, F.col("n")), F.concat("flags", F.array(outlier_flag(price, median)))
    ).otherwise(F.col("flags"))
    return joined.withColumn("vs_median_pct", signed_pct(price - median, median)).withColumn("flags", flagged).drop("n")


def cards(offers: DataFrame, key: str = "spec_key", dims: Sequence[str] = (), middle: DataFrame | None = None) -> DataFrame:
    """One row per key.

    ``dims`` are columns the key determines. Offers are not nested in the card: a
    card may hold any number of them, so they stay a table of their own
    (``with_deviation``), ordered by ``offer_positions`` when shown. ``offers`` is read
    twice, once for its counts and once for the images, so it should be a written table.

    Medians (``middle``, if the caller has written them), prices and images are tables of one row a key,
    written one by one: each sort or hash of a task holds a page at least, and all in one task add up.
    """
    rungs = stored(price_ladder(offers, [key, *dims, "source"]), "price-rungs")
    if middle is None:
        middle = stored(exact_median(rungs, [key], "price", weight="rung", out="median_price"), "medians")
    placed = rungs.join(middle, key)
    odd = is_outlier(F.col("price"), F.col("median_price"), F.col("n"))
    clean = F.when(odd, F.lit(0)).otherwise(F.col("rung_clean"))
    clean_price = F.when(clean > 0, F.col("price"))
    prices = placed.groupBy(key).agg(
        F.max("median_price").alias("median_price"),
        F.max("n").alias("offer_count"),
        F.coalesce(F.min(clean_price), F.min("price")).alias("min_price"),
        F.coalesce(F.max(clean_price), F.max("price")).alias("max_price"),
        (F.sum("rung_flags") + F.sum(F.when(odd, F.col("rung")).otherwise(0))).alias("flag_count"),
        F.sum(clean).cast("bigint").alias("clean_count"),
    )
    prices = stored(prices, "prices")
    kinds = rungs.select(key, *dims, "source").distinct()
    facts = kinds.groupBy(key).agg(F.sort_array(F.collect_set("source")).alias("sources"), *[F.first(d).alias(d) for d in dims])
    facts = facts.join(stored(first_images(offers, rungs, key), "images"), key, "left")
    joined = prices.join(facts, key)
    return joined.select(
        key, *dims, "image", "median_price", (F.col("offer_count") >= MIN_COHORT).alias("median_reliable"),
        "min_price", "max_price", "offer_count", F.size("sources").cast("bigint").alias("source_count"),
        "flag_count", "clean_count", "sources",
    )


def card_order(card_rows: DataFrame, key: str = "spec_key") -> DataFrame:
    """Most corroborated first."""
    return card_rows.orderBy(F.desc("source_count"), F.desc("offer_count"), F.asc(key))


def ranked_cards(card_rows: DataFrame, key: str = "spec_key") -> DataFrame:
    """0-based ``position`` of every card in the most-corroborated-first order."""
    levels = card_rows.withColumns({"_a": -F.col("source_count"), "_b": -F.col("offer_count")})
    return positions(levels, [], ["_a", "_b", key]).drop("_a", "_b")


def offer_positions(offers: DataFrame, key: str = "spec_key") -> DataFrame:
    """0-based position of each offer in its card, safe for a hot card."""
    hashed = F.unhex(F.md5(F.concat_ws(":", "source", "source_id")))
    keyed = offers.withColumns({"_flagged": F.size("flags") > 0, "_hash": hashed})
    return positions(keyed, [key], ["_flagged", "price", "_hash", "source", "source_id"], only_order=["_flagged", "_hash"])


def cheapest_per_source(offers: DataFrame, key: str = "spec_key") -> DataFrame:
    """The cheapest offer of each source in a card."""
    best = F.min(F.struct("price", "source_id")).alias("_best")
    found = offers.groupBy(key, "source").agg(best)
    return found.select(key, "source", F.col("_best.price").alias("price"), F.col("_best.source_id").alias("source_id"))


def unit_gap(offers: DataFrame, rial: Column, key: str = "spec_key", divisor: int = 10) -> DataFrame:
    """Cheapest offer of either publishing unit, as published, and the gap."""
    toman_min, rial_min = F.min(F.when(~rial, F.col("price"))), F.min(F.when(rial, F.col("price")))
    both = offers.groupBy(key).agg(rial_min.alias("rial_price"), toman_min.alias("toman_price"))
    gap = F.abs(F.col("rial_price") - F.col("toman_price"))
    cheaper = F.when(F.col("rial_price") < F.col("toman_price"), F.lit("rial")).when(F.col("rial_price") > F.col("toman_price"), F.lit("toman"))
    return both.select(
        key, "rial_price", "toman_price", (F.col("rial_price") * divisor).alias("as_published"),
        F.coalesce(gap, F.lit(0)).alias("gap"), cheaper.alias("cheaper"),
    )


def price_spread(offers: DataFrame, card_rows: DataFrame, key: str = "spec_key") -> DataFrame:
    """Place of each offer between the card's cheapest and dearest price, 0..100."""
    span = F.col("max_price") - F.col("min_price")
    at = F.when(span > 0, (F.col("price") - F.col("min_price")) / F.when(span > 0, span) * 100.0).otherwise(F.lit(50.0))
    return offers.join(card_rows.select(key, "min_price", "max_price"), key).withColumn("at", at)


def specimen(card_rows: DataFrame, key: str = "spec_key") -> DataFrame:
    """The best corroborated card with a picture and no finding."""
    usable = card_rows.where(F.col("image").isNotNull() & (F.col("flag_count") == 0) & (F.col("source_count") >= 3))
    return card_order(usable, key).limit(1)


def market_rollup(offers: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Counts and the price range at each level of a hierarchy."""
    return offers.rollup(*levels).agg(
        F.count(F.lit(1)).alias("offers"), F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        F.grouping_id().alias("level"),
    )


def index_totals(card_rows: DataFrame) -> DataFrame:
    """One row: cards, all their offers, and cards that several sources back."""
    return card_rows.agg(
        F.count(F.lit(1)).alias("cards"), F.coalesce(F.sum("offer_count"), F.lit(0)).alias("offers"), F.count_if(F.col("source_count") > 1).alias("multi_source")
    )


def funnel(captures: DataFrame, listings: DataFrame) -> DataFrame:
    """Captured, collapsed, unique, indexed, unresolved, flagged, specs, sources.

    ``listings`` holds one row per listing with ``spec_key``, ``price``, ``source``
    and the record flags; ``flagged_offers`` does not count the cohort finding.
    """
    indexed = F.col("spec_key").isNotNull() & F.col("price").isNotNull()
    per_listing = listings.agg(
        F.count(F.lit(1)).alias("listings"),
        F.count_if(indexed).alias("indexed"),
        F.count_if(indexed & (F.size("flags") > 0)).alias("flagged_offers"),
        F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"),
    )
    per_spec = listings.where(indexed).groupBy("spec_key").agg(F.min("source").alias("lo"), F.max("source").alias("hi"))
    specs = per_spec.agg(F.count(F.lit(1)).alias("specs"), F.count_if(F.col("lo") < F.col("hi")).alias("multi_source_specs"))
    captured = captures.agg(F.count(F.lit(1)).alias("n")).scalar()
    base = per_listing.select(
        captured.alias("listings_captured"), "*",
        specs.select("specs").scalar().alias("specs"), specs.select("multi_source_specs").scalar().alias("multi_source_specs"),
    )
    collapsed = F.col("listings_captured") - F.col("listings")
    return base.select(
        "listings_captured", "listings", "indexed", (F.col("listings") - F.col("indexed")).alias("unresolved"),
        collapsed.alias("duplicates_collapsed"),
        signed_pct(F.col("indexed"), F.greatest(F.col("listings"), F.lit(1))).alias("resolved_pct"),
        "specs", "multi_source_specs", "flagged_offers", "sources",
        signed_pct(collapsed, F.greatest(F.col("listings_captured"), F.lit(1)), 0).alias("collapsed_pct"),
    )


def budget_presets(card_rows: DataFrame, ladder: Sequence[int], picks: int = 4) -> DataFrame:
    """Round budgets between the cheapest price and the upper middle card."""
    upper = order_statistics(
        card_rows.withColumn("_all", F.lit(1)), ["_all"], "median_price", {"hi": lambda n: F.floor(n / 2) + 1}
    )
    bounds = card_rows.agg(F.min("min_price").alias("lo")).select("lo", upper.select("hi").scalar().alias("hi"))
    rungs = F.filter(F.array(*[F.lit(v).cast("bigint") for v in ladder]), lambda v: (v * 1_000_000 >= F.col("lo")) & (v * 1_000_000 <= F.col("hi")))
    held = bounds.select(rungs.alias("rungs")).where(F.size("rungs") >= 2)
    last = F.size("rungs") - 1
    at = [F.floor(last * i / (picks - 1) + 0.5).cast("int") for i in range(picks)]
    return held.select(F.explode(F.array_distinct(F.array(*[F.element_at("rungs", a + 1) for a in at]))).alias("budget_millions"))
