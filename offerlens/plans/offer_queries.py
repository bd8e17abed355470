"""Queries over offers and cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions.labels import compact_money, mileage_band, position_verdict
from offerlens.functions.numbers import signed_pct
from offerlens.operators import cards as C
from offerlens.operators import lookup, ranking
from offerlens.operators.flags import flag_histogram, flag_rows
from offerlens.plans import bindings as B
from offerlens.plans.registry import query
from offerlens.plans.store import stored

SCALE = ranking.Scale(first_year=B.FIRST_YEAR, last_year=B.LAST_YEAR, buckets=4, sources=3)

LINES = """lines AS (
  SELECT 's' || (l_orderkey % 5) AS source, l_orderkey || '-' || l_linenumber AS source_id, l_shipdate AS seen_at,
    year(l_shipdate) AS year, CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
    CAST((l_quantity - 1) * 20000 AS BIGINT) AS mileage_km, l_returnflag AS body_status,
    CASE WHEN l_linestatus = 'F' THEN 'https://img.example/' || l_suppkey || '.jpg' END AS image, l_partkey, l_suppkey
  FROM lineitem),
kept AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY source, source_id ORDER BY seen_at DESC, l_partkey DESC,
    l_suppkey DESC, price DESC, mileage_km DESC, body_status DESC, image DESC NULLS LAST) = 1)"""
LISTINGS = LINES + """,
listings AS (
  SELECT p_brand || '/' || p_type || '/' || year || '/' || (mileage_km // 250000) AS spec_key, p_brand AS brand, p_type AS model,
    year, CAST(mileage_km // 250000 AS INTEGER) AS km_bucket, source, source_id, p_name AS title, price, mileage_km, body_status,
    image, seen_at,
    mileage_km >= 800000 AS f_sentinel, mileage_km = 0 AND 2002 - year > 2 AS f_old,
    mileage_km = 0 AND body_status IN ('R', 'N') AS f_body,
    mileage_km > 0 AND 2002 - year > 0 AND mileage_km > (2002 - year) * 250000 AS f_rate,
    CAST(mileage_km >= 800000 AS INT) + CAST(mileage_km = 0 AND 2002 - year > 2 AS INT)
      + CAST(mileage_km = 0 AND body_status IN ('R', 'N') AS INT)
      + CAST(mileage_km > 0 AND 2002 - year > 0 AND mileage_km > (2002 - year) * 250000 AS INT) AS nflags
  FROM kept JOIN part ON l_partkey = p_partkey),
medians AS (SELECT spec_key, CAST(floor(median(price)) AS BIGINT) AS median_price, count(*) AS n FROM listings GROUP BY 1),
offers AS (
  SELECT l.*, m.median_price, n,
    sign(price - median_price) * ((2000 * abs(price - median_price) + median_price) // (2 * median_price)) / 10.0 AS vs_median_pct,
    n >= 3 AND (price * 5 < median_price * 2 OR price * 2 > median_price * 5) AS f_outlier,
    nflags + CAST(n >= 3 AND (price * 5 < median_price * 2 OR price * 2 > median_price * 5) AS INT) AS allflags
  FROM listings l JOIN medians m USING (spec_key))"""
CARDS = LISTINGS + """,
cards AS (
  SELECT spec_key, first(brand) AS brand, first(model) AS model, first(year) AS year, first(km_bucket) AS km_bucket,
    arg_min(image, (price, source, source_id)) FILTER (image IS NOT NULL) AS image,
    first(median_price) AS median_price, count(*) >= 3 AS median_reliable,
    coalesce(min(price) FILTER (allflags = 0), min(price)) AS min_price,
    coalesce(max(price) FILTER (allflags = 0), max(price)) AS max_price, count(*) AS offer_count,
    count(DISTINCT source) AS source_count, CAST(sum(allflags) AS BIGINT) AS flag_count,
    count(*) FILTER (allflags = 0) AS clean_count, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
  FROM offers GROUP BY 1)"""
WEIGHTS = """weights(mode, w1, w2, w3, w4, w5) AS (VALUES ('relevant', 0.30::DOUBLE, 0.20::DOUBLE, 0.20::DOUBLE, 0.20::DOUBLE, 0.10::DOUBLE),
  ('cheapest', 0.70, 0.10, 0.05, 0.10, 0.05), ('lowkm', 0.20, 0.55, 0.10, 0.10, 0.05), ('value', 0.40, 0.20, 0.15, 0.15, 0.10))"""


def score_sql(source: str, lo: str = "lo", hi: str = "hi") -> str:
    """Score over rows that carry the card, the bounds and the weights."""
    clamp = lambda x: f"least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"
    return f"""SELECT *, round(p1 + p2 + p3 + p4 + p5, 6) AS score FROM (SELECT *,
      w1 * (1 - CASE WHEN {hi} <= {lo} THEN 0.5::DOUBLE ELSE {clamp(f'(median_price - {lo})::DOUBLE / ({hi} - {lo})::DOUBLE')} END) AS p1,
      w2 * (1 - {clamp('km_bucket::DOUBLE / 4.0::DOUBLE')}) AS p2,
      w3 * {clamp('(year - 1995)::DOUBLE / 7.0::DOUBLE')} AS p3,
      w4 * {clamp('(source_count - 1)::DOUBLE / 2.0::DOUBLE')} AS p4,
      w5 * {clamp('1 - flag_count::DOUBLE / offer_count')} AS p5
    FROM ({source}))"""


def rank_sql(mode: str, where: str = "true") -> str:
    base = f"""SELECT c.*, w.*, min(median_price) OVER () AS lo, max(median_price) OVER () AS hi, count(*) OVER () AS total
      FROM cards c, weights w WHERE w.mode = '{mode}' AND {where}"""
    return f"WITH {CARDS}, {WEIGHTS}, ranked AS ({score_sql(base)})"


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.listings(spark, sf_dir)


SLIM = ("spec_key", *B.DIMS, "source", "source_id", "price", "image")


def listing_store(spark: SparkSession, sf_dir: str, columns: Sequence[str] = SLIM) -> DataFrame:
    """Listings as a written table, of findings only their codes: statistics read it more than once."""
    codes = F.transform("flags", lambda f: f["code"]).alias("flags")
    return stored(listings(spark, sf_dir).select(*columns, codes), "listings")


def deviations(found: DataFrame) -> DataFrame:
    """Offers as a written table with what lookups and positions read."""
    offers = C.with_deviation(found.select("spec_key", "source", "source_id", "price", "flags"))
    return stored(offers.withColumn("flags", F.transform("flags", lambda f: f["code"])), "offers")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cards(listing_store(spark, sf_dir), dims=B.DIMS)


def card_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards as a written table: ranking and lookups read it more than once."""
    return stored(cards(spark, sf_dir), "cards")


@query("latest_capture", f"WITH {LINES} SELECT source, source_id, seen_at, price, mileage_km, body_status, image FROM kept")
def latest_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = C.latest_captures(B.lines(spark, sf_dir), B.newest_first())
    return kept.select("source", "source_id", "seen_at", "price", "mileage_km", "body_status", "image")


@query("capture_funnel", f"""WITH {LISTINGS}, counts AS (
  SELECT (SELECT count(*) FROM lines) AS captured, count(*) AS listings, count(*) FILTER (nflags > 0) AS flagged,
    string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM listings),
specs AS (SELECT count(*) AS specs, count(*) FILTER (s > 1) AS multi FROM (SELECT count(DISTINCT source) AS s FROM listings GROUP BY spec_key))
SELECT captured AS listings_captured, listings, listings AS indexed, CAST(0 AS BIGINT) AS unresolved,
  captured - listings AS duplicates_collapsed, 100.0::DOUBLE AS resolved_pct, specs, multi AS multi_source_specs,
  flagged AS flagged_offers, sources, ((200 * (captured - listings) + captured) // (2 * captured))::DOUBLE AS collapsed_pct
FROM counts, specs""")
def capture_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.funnel(B.lines(spark, sf_dir), listings(spark, sf_dir))


FLAG_UNION = "\n  UNION ALL ".join(
    f"SELECT spec_key, source, source_id, '{code}' AS code, {message} AS message FROM listings WHERE {test}"
    for code, test, message in (
        ("mileage_sentinel", "f_sentinel", "'کارکرد ' || format('{:,}', mileage_km) || ' کیلومتر واقعی به نظر نمی‌رسد؛ احتمالاً «نامشخص» ثبت شده.'"),
        ("zero_km_old_car", "f_old", "'خودروی مدل ' || year || ' با کارکرد صفر ثبت شده است.'"),
        ("zero_km_with_bodywork", "f_body", "'کارکرد صفر اعلام شده اما بدنه «' || body_status || '» دارد.'"),
        ("mileage_vs_age", "f_rate", "'میانگین ' || format('{:,}', mileage_km // (2002 - year)) || ' کیلومتر در سال برای مدل ' || year || ' غیرعادی است.'"),
    )
)


@query("plausibility_flags", f"WITH {LISTINGS}, f AS ({FLAG_UNION}) SELECT source, source_id, code, message FROM f")
def plausibility_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_rows(listings(spark, sf_dir), ["source", "source_id"])


@query("flag_histogram", f"WITH {LISTINGS}, f AS ({FLAG_UNION}) SELECT spec_key, code, count(*) AS n, min(message) AS message FROM f GROUP BY 1, 2")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_histogram(listings(spark, sf_dir), ["spec_key"])


@query("cards", f"WITH {CARDS} SELECT * FROM cards")
def card_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards(spark, sf_dir).withColumn("sources", F.array_join("sources", ","))


@query("card_order", f"WITH {CARDS} SELECT spec_key, source_count, offer_count, row_number() OVER (ORDER BY source_count DESC, offer_count DESC, spec_key) - 1 AS position FROM cards")
def card_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ranked_cards(card_store(spark, sf_dir)).select("spec_key", "source_count", "offer_count", "position")


@query("median_deviation", f"WITH {LISTINGS} SELECT source, source_id, spec_key, price, median_price, vs_median_pct FROM offers")
def median_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.with_deviation(listings(spark, sf_dir))
    return rows.select("source", "source_id", "spec_key", "price", "median_price", "vs_median_pct")


@query("price_outliers", f"""WITH {LISTINGS} SELECT source, source_id, spec_key,
  'قیمت این آگهی ' || format('{{:,}}', price) || ' تومان است، در حالی که میانه‌ی همین خودرو ' || format('{{:,}}', median_price)
  || ' تومان است؛ ممکن است حواله، پیش‌فروش یا قیمت غیرواقعی باشد.' AS message FROM offers WHERE f_outlier""")
def price_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flag_rows(C.with_deviation(listings(spark, sf_dir)), ["source", "source_id", "spec_key"])
    return rows.where("code = 'price_outlier'").drop("code")


@query("offer_positions", f"""WITH {LISTINGS} SELECT spec_key, source, source_id, row_number() OVER (PARTITION BY spec_key
  ORDER BY allflags > 0, price, md5(source || ':' || source_id)) - 1 AS position FROM offers""")
def offer_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(listings(spark, sf_dir).select("spec_key", "source", "source_id", "price", "flags"), "listings")
    codes = F.transform("flags", lambda f: f["code"]).alias("flags")
    rows = C.offer_positions(C.with_deviation(found).select("spec_key", "source", "source_id", "price", codes))
    return rows.select("spec_key", "source", "source_id", "position")


@query("clean_range", f"""WITH {CARDS} SELECT o.source, o.source_id, c.min_price, c.max_price,
  CASE WHEN c.max_price > c.min_price THEN (o.price - c.min_price)::DOUBLE / (c.max_price - c.min_price) * 100 ELSE 50 END AS at
  FROM offers o JOIN cards c USING (spec_key)""")
def clean_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listing_store(spark, sf_dir, ("spec_key", "source", "source_id", "price"))
    rows = C.price_spread(found, C.cards(found))
    return rows.select("source", "source_id", "min_price", "max_price", "at")


@query("cheapest_per_source", f"""WITH {LISTINGS} SELECT spec_key, source, min(price) AS price,
  arg_min(source_id, (price, source_id)) AS source_id FROM listings GROUP BY 1, 2""")
def cheapest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cheapest_per_source(listings(spark, sf_dir))


@query("unit_gap", f"""WITH {LISTINGS}, u AS (SELECT spec_key, min(price) FILTER (source IN ('s0', 's4')) AS rial_price,
  min(price) FILTER (source NOT IN ('s0', 's4')) AS toman_price FROM listings GROUP BY 1)
SELECT *, rial_price * 10 AS as_published, coalesce(abs(rial_price - toman_price), 0) AS gap,
  CASE WHEN rial_price < toman_price THEN 'rial' WHEN rial_price > toman_price THEN 'toman' END AS cheaper FROM u""")
def unit_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unit_gap(listings(spark, sf_dir), F.col("source").isin("s0", "s4"))


@query("market_rollup", f"""WITH {LISTINGS} SELECT brand, model, year, count(*) AS offers, min(price) AS min_price, max(price) AS max_price,
  grouping(brand, model, year) AS level FROM listings GROUP BY ROLLUP (brand, model, year)""")
def market_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.market_rollup(listings(spark, sf_dir), ["brand", "model", "year"])


def _ranked(mode: str) -> None:
    sql = rank_sql(mode) + " SELECT spec_key, score, median_price, total FROM ranked ORDER BY score DESC, spec_key LIMIT 24"

    @query(f"rank_{mode}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        top = ranking.rank(card_store(spark, sf_dir), mode=mode, scale=SCALE)
        return top.select("spec_key", "score", "median_price", "total")


for _mode in ranking.MODES:
    _ranked(_mode)


@query("rank_filtered", rank_sql(
    "value", "brand = 'Brand#7' AND year >= 1997 AND year <= 2001 AND min_price <= 3000000 AND max_price >= 1000000"
    " AND source_count > 1 AND clean_count > 0 AND (contains(sources, 's1') OR contains(sources, 's3'))"
) + " SELECT spec_key, score, total FROM ranked ORDER BY score DESC, spec_key LIMIT 24")
def rank_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    intent = ranking.Intent(
        brand="Brand#7", year_min=1997, year_max=2001, price_max=3_000_000, price_min=1_000_000,
        sources=("s1", "s3"), multi_only=True, unflagged=True, priority="value",
    )
    return ranking.rank(card_store(spark, sf_dir), intent, mode="unknown", scale=SCALE).select("spec_key", "score", "total")


@query("score_breakdown", rank_sql("relevant") + """, long AS (SELECT spec_key, unnest([
  {'f': 'price', 'v': p1}, {'f': 'mileage', 'v': p2}, {'f': 'age', 'v': p3}, {'f': 'corroborate', 'v': p4}, {'f': 'integrity', 'v': p5}]) AS e FROM ranked)
SELECT spec_key, e.f AS factor, round(e.v, 9) AS value, round(e.v / greatest(max(e.v) OVER (PARTITION BY spec_key), 0.001), 9) AS share FROM long""")
def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.breakdown_rows(ranking.rank(card_store(spark, sf_dir), mode="relevant", k=None, scale=SCALE))
    return rows.select("spec_key", "factor", F.round("value", 9).alias("value"), F.round("share", 9).alias("share"))


@query("budget_fit", f"""WITH {CARDS}, budgets AS (SELECT DISTINCT CAST(floor(o_totalprice / 1000) AS BIGINT) * 1000 AS budget FROM orders)
SELECT budget, count(*) FILTER (min_price <= budget) AS fits, count(*) FILTER (min_price > budget AND min_price <= budget * 110 // 100) AS extra
FROM budgets, cards GROUP BY 1""")
def budget_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    budget = (F.floor(F.col("o_totalprice") / 1000) * 1000).cast("bigint")
    budgets = B.table(spark, sf_dir, "orders").select(budget.alias("budget")).distinct()
    return ranking.budget_fit(card_store(spark, sf_dir), budgets)


@query("budget_by_brand", rank_sql("value", "min_price <= 1500000") + """, top AS (SELECT * FROM ranked ORDER BY score DESC, spec_key LIMIT 60)
SELECT brand, count(*) OVER (PARTITION BY brand) AS group_size, spec_key, score FROM top""")
def budget_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ranking.rank(card_store(spark, sf_dir), ranking.Intent(price_max=1_500_000), mode="value", k=60, scale=SCALE)
    return ranking.grouped_by_brand(top).select("brand", "group_size", "spec_key", "score")


LADDER = [10, 20, 30, 40, 50, 60, 80, 100, 120, 150, 200, 250, 300, 400, 500, 700]


@query("budget_presets", f"""WITH {CARDS}, b AS (SELECT min(min_price) * 100 AS lo, list_sort(list(median_price))[CAST(floor(count(*) / 2) AS BIGINT) + 1] * 100 AS hi FROM cards),
r AS (SELECT list_filter({LADDER}, lambda v: v * 1000000 >= lo AND v * 1000000 <= hi) AS rungs FROM b),
p AS (SELECT unnest([rungs[CAST(floor((len(rungs) - 1) * i / 3.0 + 0.5) AS INT) + 1] FOR i IN [0, 1, 2, 3]]) AS v FROM r WHERE len(rungs) >= 2)
SELECT DISTINCT CAST(v AS BIGINT) AS budget_millions FROM p""")
def budget_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = card_store(spark, sf_dir).withColumns({"min_price": F.col("min_price") * 100, "median_price": F.col("median_price") * 100})
    return C.budget_presets(scaled, LADDER)


@query("similar_cards", rank_sql("value") + """,
own AS (SELECT a.spec_key, b.spec_key AS peer, row_number() OVER (PARTITION BY a.spec_key ORDER BY b.score DESC, b.spec_key) AS place
  FROM ranked a JOIN ranked b ON a.brand = b.brand AND a.spec_key <> b.spec_key QUALIFY place <= 4)
SELECT spec_key, place, peer, 'brand' AS why FROM own""")
def similar_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.rank(card_store(spark, sf_dir), mode="value", k=None, scale=SCALE)
    return ranking.similar_cards(stored(ranked.drop("breakdown"), "ranked"))


@query("similar_in_small_groups", rank_sql("value") + """, g AS (SELECT *, brand || model || year AS grp FROM ranked),
pool AS (SELECT a.spec_key, b.spec_key AS peer, b.score, CASE WHEN a.grp = b.grp THEN 'brand' ELSE 'price' END AS why
  FROM g a JOIN g b ON a.spec_key <> b.spec_key AND (a.grp = b.grp OR b.median_price BETWEEN floor(a.median_price * 85 / 100 + 0.5)
    AND floor(a.median_price * 115 / 100 + 0.5)))
SELECT spec_key, row_number() OVER (PARTITION BY spec_key ORDER BY why, score DESC, peer) AS place, peer, why FROM pool QUALIFY place <= 4""")
def similar_in_small_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.rank(card_store(spark, sf_dir), mode="value", k=None, scale=SCALE)
    grouped = ranked.withColumn("grp", F.concat("brand", "model", F.col("year").cast("string")))
    return ranking.similar_cards(stored(grouped.drop("breakdown"), "ranked"), group="grp")


_HIGH = """h AS (SELECT p_partkey AS spec_key, p_brand || p_partkey % 7 AS grp, p_size AS score, CAST(140737488355328 AS BIGINT) + p_partkey * 1000000007 AS median_price FROM part)"""


@query("similar_high_prices", f"""WITH {_HIGH}, pool AS (SELECT a.spec_key, b.spec_key AS peer, b.score, CASE WHEN a.grp = b.grp THEN 'brand' ELSE 'price' END AS why
  FROM h a JOIN h b ON a.spec_key <> b.spec_key AND (a.grp = b.grp OR b.median_price BETWEEN (a.median_price::HUGEINT * 85 + 50) // 100 AND (a.median_price::HUGEINT * 115 + 50) // 100))
SELECT spec_key, row_number() OVER (PARTITION BY spec_key ORDER BY why, score DESC, peer) AS place, peer, why FROM pool QUALIFY place <= 4""")
def similar_high_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers among prices beyond 2**47: price blocks of every size take part."""
    part = B.table(spark, sf_dir, "part")
    high = part.select(
        F.col("p_partkey").alias("spec_key"), F.concat("p_brand", (F.col("p_partkey") % 7).cast("string")).alias("grp"), F.col("p_size").alias("score"),
        (F.lit(1 << 47) + F.col("p_partkey") * 1_000_000_007).alias("median_price"),
    )
    return ranking.similar_cards(high, group="grp")


@query("specimen", f"""WITH {CARDS} SELECT spec_key, source_count, offer_count, image FROM cards
  WHERE image IS NOT NULL AND flag_count = 0 AND source_count >= 3 ORDER BY source_count DESC, offer_count DESC, spec_key LIMIT 1""")
def specimen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.specimen(cards(spark, sf_dir)).select("spec_key", "source_count", "offer_count", "image")


@query("reverse_lookup", f"""WITH {LISTINGS}, urls AS (SELECT source, source_id, spec_key, price FROM offers),
clean AS (SELECT spec_key, source, source_id, price, row_number() OVER (PARTITION BY spec_key ORDER BY price, source, source_id) AS r FROM offers WHERE allflags = 0),
srcs AS (SELECT spec_key, count(DISTINCT source) AS s FROM offers GROUP BY 1),
best AS (SELECT u.*, c.price AS cheapest_price, c.source || ':' || c.source_id AS cheapest FROM urls u LEFT JOIN clean c ON c.spec_key = u.spec_key AND c.r <= 2
  AND (c.source <> u.source OR c.source_id <> u.source_id)
  QUALIFY row_number() OVER (PARTITION BY u.source, u.source_id ORDER BY c.price NULLS LAST, c.source, c.source_id) = 1)
SELECT 'found' AS status, source, source_id, spec_key, price, cheapest_price, cheapest,
  CASE WHEN price > cheapest_price THEN (price - cheapest_price) * 100.0::DOUBLE / cheapest_price END AS overpay_pct,
  s - 1 AS other_sources, CASE WHEN s = 1 THEN 'only' END AS note FROM best JOIN srcs USING (spec_key)""")
def reverse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(listings(spark, sf_dir).select("spec_key", "source", "source_id", "price", "flags"), "listings")
    return _lookup_rows(deviations(found))


def _lookup_rows(offers: DataFrame) -> DataFrame:
    """Every offer pasted as the URL its marketplace would give it.

    The five sources are named after the marketplaces, ids lose their dash so that
    each URL rule can carry them, and the names are mapped back at the end.
    """
    names = ["divar", "bama", "hamrah", "khodro45", "sheypoor"]
    to_name = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(f"s{i}"), F.lit(n))])
    back = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(f"s{i}"))])
    digits = F.regexp_replace("source_id", "-", "000")
    named = offers.withColumn("_was", F.col("source_id")).withColumn("source_id", digits).withColumn("source", to_name[F.col("source")])
    url = (
        F.when(F.col("source") == "divar", F.concat(F.lit("https://divar.ir/v/some-title/"), "source_id"))
        .when(F.col("source") == "bama", F.concat(F.lit("www.bama.ir/car/detail-"), "source_id", F.lit("-slug?x=1")))
        .when(F.col("source") == "hamrah", F.concat(F.lit("https://www.hamrah-mechanic.com/cars-for-sale/a/b/"), "source_id", F.lit("/")))
        .when(F.col("source") == "khodro45", F.concat(F.lit("http://khodro45.com/used-car/"), "source_id", F.lit("/#top")))
        .otherwise(F.concat(F.lit("https://sheypoor.com/v/a-b-c-"), "source_id", F.lit(".html")))
    )
    urls = named.select(url.alias("url"), F.col("_was").alias("was"))
    found = lookup.reverse_lookup(named.drop("_was"), urls)
    joined = found.join(urls, "url")
    undo = lambda c: F.regexp_replace(c, "000(?=[0-9]$)", "-")
    return joined.select(
        "status", back[F.col("source")].alias("source"), F.col("was").alias("source_id"), "spec_key", "price", "cheapest_price",
        F.concat(back[F.col("cheapest_source")], F.lit(":"), undo("cheapest_id")).alias("cheapest"), "overpay_pct", "other_sources", "note",
    )


@query("cheaper_offers", f"""WITH {LISTINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY spec_key ORDER BY price, source, source_id) AS at,
    rank() OVER (PARTITION BY spec_key ORDER BY price) - 1 AS below FROM listings),
few AS (SELECT a.source, a.source_id, string_agg(b.source || ':' || b.source_id, ',' ORDER BY b.at) AS cheaper
  FROM r a JOIN r b ON a.spec_key = b.spec_key AND b.at <= 4 AND b.price < a.price GROUP BY 1, 2)
SELECT r.spec_key, r.source, r.source_id, r.price, r.below AS cheaper_count, coalesce(few.cheaper, '') AS cheaper FROM r LEFT JOIN few USING (source, source_id)""")
def cheaper_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = listings(spark, sf_dir)
    return lookup.cheaper_offers(offers.select("spec_key", "source", "source_id", "price"), offers)


@query("saved_deltas", f"""WITH {CARDS}, saved AS (SELECT c_custkey AS user_id, 'Brand#' || (c_custkey % 26) || '/' || (CASE c_nationkey % 3 WHEN 0 THEN 'PROMO' WHEN 1 THEN 'SMALL' ELSE 'LARGE' END)
  || '/' || (1995 + c_nationkey % 7) || '/' || (c_custkey % 4) AS spec_key, CAST(round(abs(c_acctbal) * 1000) AS BIGINT) AS saved_median FROM customer)
SELECT user_id, s.spec_key, saved_median, CASE WHEN c.spec_key IS NULL THEN 'gone' ELSE 'live' END AS state,
  CASE WHEN median_reliable THEN median_price END AS median_now,
  CASE WHEN median_reliable AND saved_median > 0 AND abs(median_price - saved_median) >= 1000000 THEN median_price - saved_median END AS diff,
  CASE WHEN median_reliable AND saved_median > 0 AND abs(median_price - saved_median) >= 1000000 THEN (median_price - saved_median) * 100.0::DOUBLE / saved_median END AS diff_pct
FROM saved s LEFT JOIN cards c USING (spec_key)""")
def saved_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_nationkey") % 3 == 0, "PROMO").when(F.col("c_nationkey") % 3 == 1, "SMALL").otherwise("LARGE")
    key = F.concat_ws(
        "/", F.concat(F.lit("Brand#"), (F.col("c_custkey") % 26).cast("string")), kind,
        (F.col("c_nationkey") % 7 + 1995).cast("string"), (F.col("c_custkey") % 4).cast("string"),
    )
    saved = B.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), key.alias("spec_key"),
        F.round(F.abs("c_acctbal") * 1000).cast("bigint").alias("saved_median"),
    )
    return lookup.saved_deltas(saved, cards(spark, sf_dir))


@query("recent_saved", """WITH s AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, max(ts) AS ts FROM events GROUP BY 1, 2)
SELECT user_id, k, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, k) AS rank FROM s QUALIFY rank <= 60""")
def recent_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    saves = B.table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), "ts")
    return lookup.recent_saved(saves, "user_id", "k", "ts")


@query("card_labels", f"""WITH {CARDS} SELECT spec_key,
  format('{{:,}}', km_bucket * 250) || ' تا ' || format('{{:,}}', (km_bucket + 1) * 250) || ' هزار کیلومتر' AS band,
  CASE WHEN median_price * 500 >= 1000000000
    THEN ((median_price * 500 + 50000000) // 100000000 // 10) || CASE WHEN (median_price * 500 + 50000000) // 100000000 % 10 > 0
      THEN '.' || ((median_price * 500 + 50000000) // 100000000 % 10) ELSE '' END || ' میلیارد'
    ELSE format('{{:,}}', (median_price * 500 + 500000) // 1000000) || ' میلیون' END AS money FROM cards""")
def card_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards(spark, sf_dir).select(
        "spec_key", mileage_band(F.col("km_bucket"), 250).alias("band"), compact_money(F.col("median_price") * 500).alias("money")
    )


@query("position_verdicts", f"""WITH {LISTINGS} SELECT source, source_id, CASE WHEN n >= 3 THEN CASE WHEN floor(abs(vs_median_pct) + 0.5) < 1 THEN 'تقریباً روی میانه‌ی بازار'
  ELSE CAST(CAST(floor(abs(vs_median_pct) + 0.5) AS BIGINT) AS VARCHAR) || CASE WHEN vs_median_pct > 0 THEN '٪ بالاتر از میانه‌ی بازار' ELSE '٪ پایین‌تر از میانه‌ی بازار' END END END AS verdict FROM offers""")
def position_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listings(spark, sf_dir)
    middle = C.medians(found)
    rows = found.join(middle, "spec_key")
    pct = signed_pct(F.col("price") - F.col("median_price"), F.col("median_price"))
    return rows.select("source", "source_id", position_verdict(pct, F.col("n") >= C.MIN_COHORT).alias("verdict"))
