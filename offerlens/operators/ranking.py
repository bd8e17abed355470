"""Filter, score and rank cards; one query as predicates, many queries as a join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions.numbers import clamp01, unit_range
from offerlens.operators.dominance import ASK, CARD, CLOSE, QUERY, best_by_sweep
from offerlens.operators.scale import running_totals, top_per_group
from offerlens.plans.store import stored

# Weights of the five factors in each ranking mode.
FACTORS = ("price", "mileage", "age", "corroborate", "integrity")
MODES = {
    "relevant": (0.30, 0.20, 0.20, 0.20, 0.10),
    "cheapest": (0.70, 0.10, 0.05, 0.10, 0.05),
    "lowkm": (0.20, 0.55, 0.10, 0.10, 0.05),
    "value": (0.40, 0.20, 0.15, 0.15, 0.10),
}
SIMILAR_BAND_PCT = 15


@dataclass(frozen=True)
class Scale:
    """Ranges that map a card's year, mileage band and sources to 0..1."""

    first_year: int = 1380
    last_year: int = 1405
    buckets: int = 20
    sources: int = 3


@dataclass(frozen=True)
class Intent:
    """Filters of one query; None or empty means not asked for."""

    brand: str | None = None
    model: str | None = None
    gearbox: str | None = None
    year_min: int | None = None
    year_max: int | None = None
    price_min: int | None = None
    price_max: int | None = None
    sources: Sequence[str] = ()
    multi_only: bool = False
    unflagged: bool = False
    priority: str = "relevant"


def matches(intent: Intent) -> Column:
    """Predicates for the set fields only, so a stored cards table can push them down."""
    tests: list[Column] = []
    for name in ("brand", "model", "gearbox"):
        if getattr(intent, name):
            tests.append(F.col(name) == getattr(intent, name))
    if intent.year_min:
        tests.append(F.col("year") >= intent.year_min)
    if intent.year_max:
        tests.append(F.col("year") <= intent.year_max)
    if intent.price_max:
        tests.append(F.col("min_price") <= intent.price_max)
    if intent.price_min:
        tests.append(F.col("max_price") >= intent.price_min)
    if intent.sources:
        tests.append(F.arrays_overlap("sources", F.array(*[F.lit(s) for s in intent.sources])))
    if intent.multi_only:
        tests.append(F.col("source_count") > 1)
    if intent.unflagged:
        tests.append(F.col("clean_count") > 0)
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def factors(lo: Column, hi: Column, scale: Scale) -> dict[str, Column]:
    """The five factors of a card, each in 0..1."""
    bucket = F.col("km_bucket")
    flags = F.col("flag_count").cast("double") / F.when(F.col("offer_count") > 0, F.col("offer_count"))
    return {
        "price": 1 - unit_range(F.col("median_price"), lo, hi),
        "mileage": F.when(bucket.isNotNull(), 1 - unit_range(bucket, F.lit(0), F.lit(scale.buckets))).otherwise(0.5),
        "age": unit_range(F.col("year"), F.lit(scale.first_year), F.lit(scale.last_year)),
        "corroborate": unit_range(F.col("source_count"), F.lit(1), F.lit(scale.sources)),
        "integrity": F.coalesce(clamp01(1 - flags), F.lit(1.0)),
    }


def scored(cards: DataFrame, weights: Mapping[str, Column], lo: Column, hi: Column, scale: Scale) -> DataFrame:
    """Add ``score`` and ``breakdown``; the terms of the breakdown sum to the score."""
    parts = {name: weights[name] * f for name, f in factors(lo, hi, scale).items()}
    staged = cards.withColumns({f"_p_{name}": part for name, part in parts.items()})
    total = F.col(f"_p_{FACTORS[0]}")
    for name in FACTORS[1:]:
        total = total + F.col(f"_p_{name}")
    breakdown = F.create_map(*[x for name in FACTORS for x in (F.lit(name), F.col(f"_p_{name}"))])
    return staged.withColumn("score", F.round(total, 6)).withColumn("breakdown", breakdown).drop(*[f"_p_{n}" for n in FACTORS])


def effective_mode(mode: str | None, intent: Intent) -> str:
    return mode if mode in MODES else intent.priority if intent.priority in MODES else "relevant"


def rank(cards: DataFrame, intent: Intent = Intent(), mode: str | None = None, k: int | None = 24, scale: Scale = Scale(), key: str = "spec_key") -> DataFrame:
    """Top ``k`` cards of one query, with the number matched before the cut.

    Price is judged inside the matched set. Its bounds come from a one-row
    aggregate read as a scalar, so no window gathers the whole set.
    """
    matched = cards.where(matches(intent))
    bounds = matched.agg(
        F.struct(F.min("median_price").alias("lo"), F.max("median_price").alias("hi"), F.count(F.lit(1)).alias("n")).alias("b")
    ).scalar()
    framed = matched.withColumn("_b", bounds)
    weights = {name: F.lit(w) for name, w in zip(FACTORS, MODES[effective_mode(mode, intent)])}
    out = scored(framed, weights, F.col("_b.lo"), F.col("_b.hi"), scale).withColumn("total", F.col("_b.n")).drop("_b")
    ordered = out.orderBy(F.desc("score"), F.asc(key))
    return ordered if k is None else ordered.limit(k)


def _mode_weights(mode: Column) -> dict[str, Column]:
    table = {name: F.create_map(*[x for m, w in MODES.items() for x in (F.lit(m), F.lit(w[i]))]) for i, name in enumerate(FACTORS)}
    return {name: F.element_at(t, mode) for name, t in table.items()}


PROFILE = ("brand", "model", "gearbox", "year_min", "year_max", "price_min", "price_max", "sources", "multi_only", "unflagged")


def _tests(q: Mapping[str, Column], cards: DataFrame) -> Column:
    """Everything a query asks but its price limits."""
    tests = [q[f].isNull() | (q[f] == F.col(f)) for f in ("brand", "model", "gearbox") if f in cards.columns] + [
        q["year_min"].isNull() | (F.col("year") >= q["year_min"]),
        q["year_max"].isNull() | (F.col("year") <= q["year_max"]),
        q["sources"].isNull() | F.arrays_overlap("sources", q["sources"]),
        ~q["multi_only"] | (F.col("source_count") > 1),
        ~q["unflagged"] | (F.col("clean_count") > 0),
    ]
    hit = tests[0]
    for test in tests[1:]:
        hit = hit & test
    return hit


def rank_many(cards: DataFrame, intents: DataFrame, k: int = 24, scale: Scale = Scale(), key: str = "spec_key", query: str = "query_id") -> DataFrame:
    """Top ``k`` cards of every query in one job.

    Equal intents are ranked once. Intents that agree in all but their price limits are one
    set: each set meets its cards once, by equality on the tightest of (brand and model,
    brand, any), and one sweep in order of price answers all of its limits
    (:mod:`offerlens.operators.dominance`). So the work follows the different sets, which
    the vocabulary bounds, and the queries, not queries times cards. An intent whose floor
    lies above its ceiling is counted by a join of its own set.
    """
    mode = F.when(F.col("mode").isin(*MODES), F.col("mode")) if "mode" in intents.columns else F.lit(None)
    mode = F.coalesce(mode, F.when(F.col("priority").isin(*MODES), F.col("priority")), F.lit("relevant"))
    asked = intents.withColumn("_mode", mode)
    plain = [p for p in PROFILE if p not in ("price_min", "price_max")]
    asked = asked.withColumn("_floors", F.col("price_min").isNotNull())
    asked = asked.withColumn("_set", F.md5(F.to_json(F.struct(*plain, "_mode", "_floors"))))
    asked = asked.withColumn("_profile", F.md5(F.to_json(F.struct("_set", "price_min", "price_max"))))
    asked = stored(asked, "intents")
    profiles = asked.select("_profile", "_set", "_mode", "price_min", "price_max", "_floors").dropDuplicates(["_profile"])
    sets = asked.select("_set", "_mode", "_floors", *[F.col(p).alias(f"_q_{p}") for p in plain]).dropDuplicates(["_set"])
    q = {p: F.col(f"_q_{p}") for p in plain}
    block = F.when(q["brand"].isNotNull() & q["model"].isNotNull(), F.concat_ws("/", q["brand"], q["model"])).otherwise(F.coalesce(q["brand"], F.lit("*")))
    blocks = F.array_distinct(F.array(F.lit("*"), F.col("brand"), F.concat_ws("/", "brand", "model")))
    placed = cards.withColumn("_block", F.explode(blocks))
    weights = _mode_weights(F.col("_mode"))
    parts = factors(F.lit(0), F.lit(1), scale)
    rest = sum((weights[name] * parts[name] for name in FACTORS[2:]), weights[FACTORS[1]] * parts[FACTORS[1]])
    met = placed.join(sets.withColumn("_block", block), "_block").where(_tests(q, cards))
    met = stored(met.select(
        "_set", "_floors", F.col(key).alias("_id"), F.col("min_price").alias("_at"), F.col("max_price").alias("_top"), F.col("median_price").alias("_median"),
        rest.alias("_rest"), weights["price"].alias("_weight"),
    ), "set-cards")
    spans = met.groupBy("_set").agg((F.max("_median") - F.min("_median")).alias("_span"), F.first("_weight").alias("_weight"))
    none = lambda kind: F.lit(None).cast(kind)
    event = lambda df, at, kind, id_, median, rest, top, floor: df.join(spans, "_set").select(
        "_set", at.alias("_at"), F.lit(kind).alias("_kind"), id_.alias("_id"), median.alias("_median"), rest.alias("_rest"), top.alias("_top"), floor.alias("_floor"), "_weight", "_span", "_floors"
    )
    met_rows, limited = met.drop("_weight"), profiles.where("_floors")
    blank = (none("bigint"), none("double"), none("bigint"))
    events = event(met_rows, F.col("_at"), CARD, F.col("_id"), F.col("_median"), F.col("_rest"), F.col("_top"), none("bigint"))
    events = events.unionByName(event(met_rows.where("_floors"), F.col("_top"), CLOSE, F.col("_id"), *blank, none("bigint")))
    events = events.unionByName(event(profiles, F.coalesce("price_max", F.lit((1 << 63) - 1)), QUERY, F.col("_profile"), *blank, F.col("price_min")))
    events = events.unionByName(event(limited, F.col("price_min"), ASK, F.col("_profile"), *blank, none("bigint")))
    found = stored(best_by_sweep(events, k), "swept")

    ranges = found.where("_part = 'range'").select("_profile", "_lo", "_hi", F.col("_n").alias("_open"))
    under = found.where("_part = 'under'").select("_profile", F.col("_n").alias("_under"))
    inverted = profiles.where("price_min > price_max").join(met.select("_set", "_at", "_top"), "_set").where("_at <= price_max and _top >= price_min")
    exact = inverted.groupBy("_profile").agg(F.count(F.lit(1)).alias("_exact"))
    bounds = ranges.join(under, "_profile", "left").join(exact, "_profile", "left")
    bounds = bounds.select("_profile", "_lo", "_hi", F.coalesce("_exact", F.col("_open") - F.coalesce("_under", F.lit(0))).alias("total"))
    top = found.where("_part = 'top'").select("_profile", F.col("_key").alias(key))
    chosen = top.join(bounds, "_profile").join(profiles.select("_profile", "_mode"), "_profile").join(cards, key)
    ranked = scored(chosen, weights, F.col("_lo"), F.col("_hi"), scale)
    narrow = ranked.select("_profile", key, "score", "breakdown", "total", F.col("_mode").alias("mode_used"))
    best = top_per_group(narrow, ["_profile"], [F.desc("score"), F.asc(key)], k)
    return asked.select(query, "_profile").join(best, "_profile").drop("_profile")


def breakdown_rows(ranked: DataFrame, key: str = "spec_key") -> DataFrame:
    """One row per card and factor, largest first, scaled to the card's largest."""
    rows = ranked.select(key, F.explode("breakdown").alias("factor", "value"))
    largest = F.greatest(F.max("value").over(Window.partitionBy(key)), F.lit(0.001))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("value"), "factor"))
    return rows.select(key, "factor", "value", (F.col("value") / largest).alias("share"), place.alias("place"))


def budget_fit(cards: DataFrame, budgets: DataFrame, budget: str = "budget", stretch_pct: int = 10) -> DataFrame:
    """Cards that fit each budget and how many more a tenth would add.

    Limits join the cheapest prices as values without weight, and one running total over
    all of them tells how many cards lie at or under each limit: no budget meets a price.
    """
    wider = F.floor((F.col(budget) * (100 + stretch_pct)) / 100).cast("bigint")
    limits = budgets.select(budget).distinct().withColumn("_wider", wider)
    asked = limits.select(F.explode(F.array(budget, "_wider")).alias("_value"), F.lit(0).alias("_w"))
    priced = cards.select(F.col("min_price").alias("_value"), F.lit(1).alias("_w"))
    totals = running_totals(priced.unionByName(asked), "_value", "_w")
    fits = totals.select(F.col("_value").alias(budget), F.col("upto").alias("fits"))
    all_ = totals.select(F.col("_value").alias("_wider"), F.col("upto").alias("_all"))
    return limits.join(fits, budget).join(all_, "_wider").select(budget, "fits", (F.col("_all") - F.col("fits")).alias("extra"))


def grouped_by_brand(ranked: DataFrame, key: str = "spec_key") -> DataFrame:
    """Ranked cards regrouped by brand, largest group first, inner order kept."""
    sizes = ranked.groupBy("brand").agg(F.count(F.lit(1)).alias("group_size"))
    return ranked.join(sizes, "brand").orderBy(F.desc("group_size"), "brand", F.desc("score"), key)


def similar_cards(cards: DataFrame, k: int = 4, group: str = "brand", key: str = "spec_key", band_pct: int = SIMILAR_BAND_PCT) -> DataFrame:
    """For each card its ``k`` best peers: same group first, then a close median.

    ``cards`` carries ``score``. Pairs inside a group are never enumerated: the
    best ``k + 1`` of a group serve all its members. Only members of groups too
    small to fill the list look at the price band; the band is cut into aligned
    blocks of base 16, and each block knows its best ``2 * k`` cards, enough to
    survive leaving out the card's own group.
    """
    by_score = [F.desc("score"), F.asc(key)]
    entry = F.struct((-F.col("score")).alias("o"), F.col(key).alias("peer"), F.col(group).alias("g"))
    head = top_per_group(cards.select(key, group, "score"), [group], by_score, k + 1)
    peers = head.groupBy(group).agg(F.array_sort(F.collect_list(entry)).alias("_peers"))
    # The cards may be a small file and still too many for the driver.
    own = cards.select(key, group, "median_price").join(peers.hint("merge"), group)
    others = F.slice(F.filter("_peers", lambda p: p["peer"] != F.col(key)), 1, k)
    own = own.withColumn("_own", others)
    out_own = own.select(key, F.posexplode("_own").alias("at", "p")).select(
        key, (F.col("at") + 1).alias("place"), F.col("p.peer").alias("peer"), F.lit("brand").alias("why")
    )

    short = own.where(F.size("_own") < k)
    shifts = list(range(0, 64, 4))
    blocks = cards.select(key, group, "score", "median_price").withColumn("_shift", F.explode(F.array(*[F.lit(s) for s in shifts])))
    blocks = blocks.withColumn("_block", F.expr("shiftright(median_price, _shift)"))
    best = top_per_group(blocks, ["_shift", "_block"], by_score, 2 * k)
    best = best.select("_shift", "_block", F.col(key).alias("peer"), F.col(group).alias("_pg"), "score")
    lo = F.floor((F.col("median_price") * (100 - band_pct)) / 100 + 0.5).cast("bigint")
    hi = F.floor((F.col("median_price") * (100 + band_pct)) / 100 + 0.5).cast("bigint")
    pieces = F.flatten(F.array(*[_aligned(lo, hi + 1, s) for s in shifts]))
    wanted = short.select(key, group, F.size("_own").alias("_have"), F.explode(pieces).alias("_piece"))
    wanted = wanted.select(key, group, "_have", F.col("_piece.s").alias("_shift"), F.col("_piece.b").alias("_block"))
    # The best of all blocks are many times the cards, which the size of their file does not tell.
    near = wanted.join(best.hint("merge"), ["_shift", "_block"]).where((F.col("peer") != F.col(key)) & (F.col("_pg") != F.col(group)))
    near = top_per_group(near, [key], [F.desc("score"), F.asc("peer")], k)
    out_near = near.where(F.col("rank") <= k - F.col("_have")).select(
        key, (F.col("_have") + F.col("rank")).alias("place"), "peer", F.lit("price").alias("why")
    )
    return out_own.unionByName(out_near)


def _aligned(lo: Column, end: Column, shift: int) -> Column:
    """Blocks of size 16**(shift/4) in ``[lo, end)`` that no larger block covers.

    At the largest size there is no larger block, so all of its blocks count.
    """
    unit, larger = 1 << shift, 1 << min(shift + 4, 62)
    down = lambda x, u: F.shiftright(x, u.bit_length() - 1)
    up = lambda x, u: down(x + (u - 1), u)
    a, b = up(lo, unit), down(end, unit)
    wa, wb = up(lo, larger) * 16, down(end, larger) * 16
    run = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
    if shift >= 60:
        return F.transform(run(a, b), lambda i: F.struct(F.lit(shift).alias("s"), i.alias("b")))
    inner = F.concat(run(a, F.least(wa, b)), run(F.greatest(wb, a), b))
    ids = F.when(wa < wb, inner).otherwise(run(a, b))
    return F.transform(ids, lambda i: F.struct(F.lit(shift).alias("s"), i.alias("b")))
