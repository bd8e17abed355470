"""Queries that keep derived tables, publish cards, and check generated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.operators import grounding as G
from offerlens.operators import maintenance as M
from offerlens.operators import cards as C
from offerlens.operators.cards import with_deviation
from offerlens.plans import bindings as B
from offerlens.plans.offer_queries import CARDS, LISTINGS, SLIM, card_store, cards, listings
from offerlens.plans.registry import query
from offerlens.plans.store import stored
from offerlens.sources import exports as E


def market(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cards and offers of one written table of listings."""
    found = stored(listings(spark, sf_dir).select(*SLIM, "mileage_km", "flags"), "listings")
    middle = stored(C.medians(found), "medians")
    return C.cards(found, dims=B.DIMS, middle=middle), with_deviation(found, middle=middle)


NOW = "2003-01-01"


def _details(rows: DataFrame) -> DataFrame:
    """Stored details for two thirds of the offers, some undated."""
    at = F.timestamp_add("DAY", -(F.col("price") % 14).cast("int"), F.lit(NOW).cast("timestamp_ntz"))
    return rows.where("price % 3 > 0").select("source", "source_id", F.when(F.col("price") % 5 > 0, at).alias("fetched_at"))


@query("due_details", f"""WITH {CARDS}, top AS (SELECT spec_key, row_number() OVER (ORDER BY source_count DESC, offer_count DESC, spec_key) AS place FROM cards QUALIFY place <= 60),
pos AS (SELECT o.*, place, row_number() OVER (PARTITION BY spec_key ORDER BY allflags > 0, price, md5(source || ':' || source_id)) - 1 AS position FROM offers o JOIN top USING (spec_key))
SELECT spec_key, source, source_id, position, row_number() OVER (PARTITION BY position, source ORDER BY place) - 1 AS turn, place FROM pos
WHERE (price % 3 = 0 OR price % 5 = 0 OR price % 14 >= 7) AND source <> 's4'""")
def due_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, offers = market(spark, sf_dir)
    rows = stored(offers.select("spec_key", "source", "source_id", "price", F.transform("flags", lambda f: f["code"]).alias("flags")), "offers")
    return M.due_details(stored(held, "cards"), rows, _details(rows), F.lit(NOW), enabled=("s0", "s1", "s2", "s3"))


@query("merge_details", f"""WITH {LISTINGS} SELECT source, source_id, 'fresh' AS origin FROM listings WHERE price % 3 = 0
UNION ALL SELECT source, source_id, 'stored' FROM listings WHERE price % 2 = 0 AND price % 3 <> 0""")
def merge_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(listings(spark, sf_dir).select("source", "source_id", "price"), "listings")
    held = rows.where("price % 2 = 0").select("source", "source_id", F.lit("stored").alias("origin"))
    ghosts = rows.where("price % 5 = 0").select("source", F.concat("source_id", F.lit("x")).alias("source_id"), F.lit("stored").alias("origin"))
    fresh = rows.where("price % 3 = 0").select("source", "source_id", F.lit("fresh").alias("origin"))
    return M.merge_details(held.unionByName(ghosts), fresh, rows)


EXPLAINED = f"""WITH {CARDS}, top AS (SELECT spec_key FROM cards ORDER BY source_count DESC, offer_count DESC, spec_key LIMIT 120),
s AS (SELECT spec_key, median_price % 3 <> 0 AS same FROM cards WHERE median_price % 2 = 0 UNION ALL SELECT spec_key || '/gone', false FROM cards WHERE median_price % 7 = 0)
, planned AS (SELECT coalesce(c.spec_key, s.spec_key) AS spec_key, CASE WHEN top.spec_key IS NOT NULL AND same THEN 'reused' WHEN top.spec_key IS NOT NULL THEN 'to_generate' WHEN same THEN 'carried' ELSE 'expired' END AS status
FROM cards c FULL JOIN s ON c.spec_key = s.spec_key LEFT JOIN top ON top.spec_key = c.spec_key WHERE top.spec_key IS NOT NULL OR s.spec_key IS NOT NULL)"""


@query("explanation_plan", f"{EXPLAINED} SELECT * FROM planned")
def explanation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_and_texts(spark, sf_dir)[0]


def _plan_and_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The plan, and the stored texts it was made from."""
    held = card_store(spark, sf_dir)
    kept = held.where("median_price % 2 = 0").select(
        "spec_key", F.when(F.col("median_price") % 3 != 0, M.fingerprint("v1")).otherwise(F.lit("old")).alias("fingerprint")
    )
    gone = held.where("median_price % 7 = 0").select(F.concat("spec_key", F.lit("/gone")).alias("spec_key"), F.lit("x").alias("fingerprint"))
    texts = kept.unionByName(gone)
    return M.warm_plan(held, texts, "v1"), texts


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The plan, the stored texts, and what a run generated: it fails for some keys."""
    plan, texts = _plan_and_texts(spark, sf_dir)
    plan = stored(plan, "warm-plan")
    made = plan.where("status = 'to_generate' AND length(spec_key) % 4 > 0").select("spec_key", F.lit("new").alias("fingerprint"))
    return plan, texts, made


_DONE = EXPLAINED + ", done AS (SELECT spec_key, CASE WHEN status <> 'to_generate' THEN status WHEN length(spec_key) % 4 > 0 THEN 'generated' ELSE 'failed' END AS status FROM planned)"


@query("explanation_coverage", f"{_DONE} SELECT s.status, count(d.spec_key) AS n FROM (VALUES ('reused'), ('generated'), ('failed'), ('carried'), ('expired')) s(status) LEFT JOIN done d USING (status) GROUP BY 1")
def explanation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, _, made = _run(spark, sf_dir)
    return M.coverage(M.warmed(plan, made))


@query("explanations_refreshed", f"{_DONE} SELECT spec_key, status = 'generated' AS fresh FROM done WHERE status IN ('generated', 'reused', 'carried')")
def explanations_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, texts, made = _run(spark, sf_dir)
    return M.refreshed(texts, made, plan).select("spec_key", (F.col("fingerprint") == "new").alias("fresh"))


@query("url_list", f"""WITH {CARDS} SELECT row_number() OVER (ORDER BY source_count DESC, offer_count DESC, spec_key) - 1 AS place, 'https://cards.example/car/' || spec_key AS loc,
  CASE WHEN source_count > 1 THEN '0.8' ELSE '0.4' END AS priority FROM cards""")
def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.url_list(card_store(spark, sf_dir), "https://cards.example")


@query("url_entries", f"""WITH {CARDS} SELECT '<url><loc>https://cards.example/?a&amp;b/car/' || spec_key || '</loc><changefreq>daily</changefreq><priority>' || CASE WHEN source_count > 1 THEN '0.8' ELSE '0.4' END || '</priority></url>' AS value FROM cards""")
def url_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.url_entries(E.url_list(card_store(spark, sf_dir), "https://cards.example/?a&b"))


@query("structured_offer", f"""WITH {CARDS} SELECT spec_key, '{{"@context":"https://schema.org","@type":"Car","name":"' || brand || ' ' || model || '","brand":{{"@type":"Brand","name":"' || brand || '"}},"model":"' || model
  || '","productionDate":"' || year || '"' || coalesce(',"image":"' || image || '"', '') || ',"offers":{{"@type":"AggregateOffer","priceCurrency":"IRR","lowPrice":' || min_price * 10 || ',"highPrice":' || max_price * 10
  || ',"offerCount":' || offer_count || '}}}}' AS record FROM cards""")
def structured_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    record = E.structured_offer(
        F.concat_ws(" ", "brand", "model"), c("brand"), c("model"), c("year"), c("min_price"), c("max_price"), c("offer_count"), c("image")
    )
    return cards(spark, sf_dir).select("spec_key", record.alias("record"))


@query("live_sources", """SELECT source, CASE WHEN source IN ('s0', 's4') THEN 'rial' ELSE 'toman' END AS unit FROM (SELECT DISTINCT 's' || l_orderkey % 5 AS source FROM lineitem)""")
def live_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(f"s{i}", "rial" if i in (0, 4) else "toman") for i in range(7)], "source string, unit string")
    return E.live_sources(B.lines(spark, sf_dir), known)


FACTS = CARDS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY spec_key ORDER BY allflags > 0, price, source, source_id) AS r, count(*) FILTER (allflags = 0) OVER (PARTITION BY spec_key) AS nclean FROM offers),
top AS (SELECT * FROM ranked WHERE r <= 3 AND (nclean = 0 OR allflags = 0)),
packed AS (SELECT spec_key, list(source ORDER BY r) AS src, list(price ORDER BY r) AS prices, list(mileage_km ORDER BY r) AS kms, list(vs_median_pct ORDER BY r) AS pcts, max(allflags) > 0 AS flagged FROM top GROUP BY 1),
facts AS (SELECT c.*, p.* EXCLUDE (spec_key), brand || ' ' || model AS title FROM cards c JOIN packed p USING (spec_key)),
told AS (SELECT *, CAST(abs(round(pcts[1])) AS BIGINT) AS pct, kms[1] - kms[2] AS gap, title || ' در «' || src[1] || '» با قیمت ' || format('{:,}', prices[1]) || ' تومان، ' AS head FROM facts),
spoken AS (SELECT *, CASE WHEN pct > 0 AND median_reliable THEN head || pct || '٪ پایین‌تر از میانه‌ی ' || format('{:,}', median_price) || ' تومانی این مدل است.'
    WHEN pct > 0 THEN head || 'ارزان‌ترین آگهی از ' || offer_count || ' آگهی موجود است.' ELSE head || 'نزدیک به میانه‌ی بازار است.' END || ' ' ||
  CASE WHEN len(src) < 2 THEN 'این مدل فقط ' || offer_count || ' آگهی دارد، پس میانه‌ی قیمت هنوز کم‌اعتبار است.'
    WHEN gap >= 5000 THEN 'در عوض ' || format('{:,}', gap) || ' کیلومتر بیشتر از گزینه‌ی بعدی (' || format('{:,}', prices[2]) || ' تومان) کار کرده است.'
    WHEN flagged THEN 'در عوض داده‌ی این آگهی یک ناسازگاری دارد که پایین‌تر نشان داده شده است.'
    WHEN -gap >= 5000 THEN 'گزینه‌ی بعدی ' || format('{:,}', prices[2]) || ' تومان است و ' || format('{:,}', -gap) || ' کیلومتر بیشتر کار کرده، پس این آگهی از هر دو نظر جلوتر است.'
    ELSE 'تفاوت اصلی‌اش با گزینه‌ی بعدی فقط قیمت است: ' || format('{:,}', prices[2]) || ' تومان از «' || src[2] || '».' END AS text FROM told)"""


def card_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, offers = market(spark, sf_dir)
    return G.facts(held, offers, F.concat_ws(" ", "brand", "model"))


@query("card_facts", f"WITH {FACTS} SELECT spec_key, title, array_to_string(src, ',') AS src, array_to_string(prices, ',') AS prices, flagged FROM facts")
def facts_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda name: F.array_join(F.transform("offers", lambda o: o[name].cast("string")), ",")
    return card_facts(spark, sf_dir).select(
        "spec_key", "title", joined("source_fa").alias("src"), joined("price").alias("prices"), (F.size("flags") > 0).alias("flagged")
    )


@query("fallback_text", f"WITH {FACTS} SELECT spec_key, text FROM spoken")
def fallback_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card_facts(spark, sf_dir).select("spec_key", G.fallback_text().alias("text"))


# Every phrase of every topic with the topics it raises, and every name of a source.
PHRASES = [p for group in G.TOPICS.values() for p in group]
RAISED = [",".join(t for t, group in G.TOPICS.items() if any(q in p for q in group)) for p in PHRASES]
NAMES = sorted({s.replace(G.HALF_SPACE, " ") for s in G.SOURCES})
_texts = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _claims() -> Column:
    """The templated text, with inventions added to some cards."""
    m = F.col("median_price")
    pick = lambda words, step: F.element_at(F.array(*[F.lit(w) for w in words]), (F.floor(m / step) % len(words) + 1).cast("int"))
    extra = F.concat(
        F.when(m % 5 == 0, F.concat(F.lit(" تا "), F.format_number(F.col("median_price") + 7, 0), F.lit(" تومان."))).otherwise(""),
        F.when(m % 7 == 0, " یعنی ۱۳۷٪ زیر میانه.").otherwise(""),
        F.when(m % 3 == 0, F.concat(F.lit(" این خودرو "), pick(PHRASES, 3), F.lit(" دارد."))).otherwise(""),
        F.when(m % 4 == 0, F.concat(F.lit(" در "), pick(NAMES, 4), F.lit(" هم هست."))).otherwise(""),
        F.when(m % 17 == 0, " کارکرد و قیمت را از دست می‌دهی.").otherwise(""),
    )
    return F.concat(G.fallback_text(), extra)


_GROUP = r",،٬\x{a0}\x{200f}\x{200e} "


@query("grounding_check", "WITH " + FACTS + f""", claims AS (SELECT * REPLACE (text || CASE WHEN median_price % 5 = 0 THEN ' تا ' || format('{{:,}}', median_price + 7) || ' تومان.' ELSE '' END
  || CASE WHEN median_price % 7 = 0 THEN ' یعنی ۱۳۷٪ زیر میانه.' ELSE '' END || CASE WHEN median_price % 3 = 0 THEN ' این خودرو ' || {_texts(PHRASES)}[median_price // 3 % {len(PHRASES)} + 1] || ' دارد.' ELSE '' END
  || CASE WHEN median_price % 4 = 0 THEN ' در ' || {_texts(NAMES)}[median_price // 4 % {len(NAMES)} + 1] || ' هم هست.' ELSE '' END || CASE WHEN median_price % 17 = 0 THEN ' کارکرد و قیمت را از دست می‌دهی.' ELSE '' END AS text) FROM spoken),
n1 AS (SELECT *, translate(text, '۰۱۲۳۴۵۶۷۸۹', '0123456789') AS t FROM claims),
n2 AS (SELECT *, [try_cast(regexp_replace(x, '[{_GROUP}]', '', 'g') AS DOUBLE) FOR x IN regexp_extract_all(t, '\\d[\\d{_GROUP}]*(?:\\.\\d+)?')] AS nums,
  [try_cast(x AS DOUBLE) FOR x IN regexp_extract_all(t, '(\\d+(?:\\.\\d+)?)\\s*(?:٪|%|درصد)', 1)] AS said,
  list_filter(flatten([[x::DOUBLE FOR x IN prices], [x::DOUBLE FOR x IN kms], [abs(x) FOR x IN pcts], [round(abs(x)) FOR x IN pcts],
    [median_price::DOUBLE, min_price::DOUBLE, max_price::DOUBLE, year::DOUBLE, offer_count::DOUBLE, source_count::DOUBLE,
     abs(prices[1] - prices[2])::DOUBLE, abs(prices[1] - prices[3])::DOUBLE, abs(prices[2] - prices[3])::DOUBLE,
     abs(kms[1] - kms[2])::DOUBLE, abs(kms[1] - kms[3])::DOUBLE, abs(kms[2] - kms[3])::DOUBLE]]), lambda x: x IS NOT NULL) AS base FROM n1),
n3 AS (SELECT *, flatten([[b, b / 1e3, round(b / 1e3), round(b / 1e3, 1), b / 1e6, round(b / 1e6), round(b / 1e6, 1), b / 1e9, round(b / 1e9), round(b / 1e9, 1)] FOR b IN base]) AS allowed,
  flatten([[abs(p), floor(abs(p)), ceil(abs(p))] FOR p IN pcts]) AS okpct FROM n2),
n4 AS (SELECT *, list_filter(nums, lambda n: n >= 100 AND len(list_filter(allowed, lambda a: abs(n - a) <= 1e-6)) = 0) AS b1,
  list_filter(said, lambda n: len(list_filter(okpct, lambda a: abs(n - a) <= 0.05)) = 0) AS b2 FROM n3),
n5 AS (SELECT spec_key, list_sort(list_distinct(list_concat(b1, b2))) AS bad,
  list_filter([CASE WHEN median_price % 3 = 0 THEN {_texts(RAISED)}[median_price // 3 % {len(PHRASES)} + 1] END, CASE WHEN median_price % 4 = 0 THEN 'source:' || {_texts(NAMES)}[median_price // 4 % {len(NAMES)} + 1] END,
    CASE WHEN median_price % 17 = 0 AND len(prices) >= 2 AND prices[1] = list_min(prices) THEN 'loss_framing_on_price' END,
    CASE WHEN median_price % 17 = 0 AND len(prices) >= 2 AND kms[1] = list_min(kms) THEN 'loss_framing_on_mileage' END], lambda x: x IS NOT NULL) AS topics FROM n4)
SELECT spec_key, len(bad) = 0 AND len(topics) = 0 AS ok, array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) FOR x IN bad], ',') AS bad_numbers, array_to_string(topics, ',') AS bad_topics FROM n5""")
def grounding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = G.check(card_facts(spark, sf_dir).withColumn("text", _claims()))
    return checked.select(
        "spec_key", "ok", F.array_join(F.transform("bad_numbers", lambda n: n.cast("bigint").cast("string")), ",").alias("bad_numbers"),
        F.array_join("bad_topics", ",").alias("bad_topics"),
    )
