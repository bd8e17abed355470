"""Queries of the read path, of keeping tables sound, and of capture lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions.labels import display_model, display_trim
from offerlens.functions.text import email_key
from offerlens.operators import alerts as AL
from offerlens.operators import cards as C
from offerlens.operators import lookup as L
from offerlens.operators.details import with_tombstones
from offerlens.operators import maintenance as M
from offerlens.operators import quality as Q
from offerlens.operators.details import capped, inspection
from offerlens.operators.flags import FlagRules, flag_rows, record_flags
from offerlens.operators.resolve import valid_key
from offerlens.plans import bindings as B
from offerlens.plans.offer_queries import CARDS, LISTINGS, card_store, listings
from offerlens.plans.registry import query
from offerlens.plans.session import shared_dir
from offerlens.plans.store import bucketed, stored
from offerlens.sources import captures as S
from offerlens.sources import exports as E

# --- lookups by key -----------------------------------------------------------


@query("point_lookup", """WITH known AS (SELECT DISTINCT o_custkey AS spec_key FROM orders), v AS (SELECT o_custkey AS spec_key, o_orderdate AS t, o_orderkey AS point FROM orders WHERE o_orderstatus = 'P')
SELECT c_custkey AS spec_key, CASE WHEN k.spec_key IS NULL THEN 'not_found' WHEN point IS NULL THEN 'empty' ELSE 'found' END AS answer, t, point
FROM customer LEFT JOIN known k ON k.spec_key = c_custkey LEFT JOIN v ON v.spec_key = c_custkey""")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of every customer asked for: customers with orders are known, pending orders are points."""
    orders = B.table(spark, sf_dir, "orders")
    asked = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("spec_key"))
    known = orders.select(F.col("o_custkey").alias("spec_key"))
    points = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("spec_key"), F.col("o_orderdate").alias("t"), F.col("o_orderkey").alias("point"))
    return L.point_lookup(asked, bucketed(known.distinct(), "known-keys", ["spec_key"]), bucketed(points, "history", ["spec_key"]))


@query("detail_lookup", f"""WITH {LISTINGS} SELECT source, source_id, CASE WHEN price % 3 = 0 AND price % 4 <> 0 AND source <> 's4' THEN 'found' ELSE 'not_found' END AS answer,
  CASE WHEN price % 3 = 0 AND price % 4 <> 0 AND source <> 's4' THEN title END AS note FROM listings""")
def detail_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing asked for; a third has details, a quarter of them tombstones, one source is unknown."""
    rows = stored(listings(spark, sf_dir).select("source", "source_id", "title", "price"), "lookup-listings")
    tried = rows.where("price % 3 = 0").select("source", "source_id", F.lit(None).cast("timestamp").alias("fetched_at"))
    got = rows.where("price % 4 <> 0").select("source", "source_id", F.col("title").alias("note"), F.lit(None).cast("timestamp").alias("fetched_at"))
    details = with_tombstones(tried, got).drop("fetched_at")
    return L.detail_lookup(rows.select("source", "source_id"), bucketed(details, "details", ["source", "source_id"]), ("s0", "s1", "s2", "s3"), F.col("note").isNull())


@query("index_totals", f"WITH {CARDS} SELECT count(*) AS cards, CAST(sum(offer_count) AS BIGINT) AS offers, count(*) FILTER (source_count > 1) AS multi_source FROM cards")
def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.index_totals(card_store(spark, sf_dir))


@query("explanations_by_source", """SELECT CASE WHEN doc_id % 11 = 0 THEN '?' ELSE source END AS source, count(*) AS n FROM documents GROUP BY 1""")
def explanations_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = B.table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 11 != 0, F.col("source")).alias("source"))
    return Q.counts_by(texts, "source")


# --- capture lines --------------------------------------------------------------

_KIND = "event_id % 9"


@query("capture_lines", f"""SELECT event_type AS source, CASE WHEN {_KIND} IN (1, 2, 3) THEN false ELSE true END AS readable,
  CASE WHEN {_KIND} NOT IN (1, 2, 3) THEN event_id END AS k, count(*) AS n FROM events WHERE {_KIND} <> 4 GROUP BY ALL""".replace("event_type AS source", f"CASE WHEN {_KIND} NOT IN (1, 2, 3) THEN event_type END AS source"))
def capture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one line of a file: objects, a number, a list, broken text, blanks."""
    event = F.to_json(F.struct(F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("source_id"), F.struct(F.col("event_id").alias("k")).alias("payload")))
    kind = F.col("event_id") % 9
    line = F.when(kind == 1, F.col("event_id").cast("string")).when(kind == 2, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]")))
    line = line.when(kind == 3, F.left(event, F.length(event) - 2)).when(kind == 4, F.lit("  ")).otherwise(event)
    path = f"{shared_dir(spark)}/offerlens/lines-{uuid.uuid4().hex}"
    B.table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    good, bad = S.read_captures(spark, path)
    told = good.select("source", F.lit(True).alias("readable"), F.get_json_object("payload", "$.k").cast("bigint").alias("k"))
    told = told.unionByName(bad.select(F.lit(None).cast("string").alias("source"), F.lit(False).alias("readable"), F.lit(None).cast("bigint").alias("k")))
    return told.groupBy("source", "readable", "k").agg(F.count(F.lit(1)).alias("n"))


@query("rejected_payloads", """SELECT event_id % 5 = 0 OR event_id % 7 = 0 AS rejected, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1""")
def rejected_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and rejected records together are all records."""
    payload = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("string")).when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(
        F.to_json(F.struct(F.struct(F.col("event_id").cast("string").alias("code")).alias("detail")))
    )
    raw = stored(B.table(spark, sf_dir, "events").select(
        F.lit("bama").alias("source"), F.lit(None).cast("string").alias("city"), F.col("event_id").cast("string").alias("list_url"),
        F.col("ts").alias("fetched_at"), payload.alias("payload"),
    ), "raw-records")
    kept = S.envelope(raw).select(F.lit(False).alias("rejected"), F.col("list_url").cast("bigint").alias("id"))
    gone = S.rejected(raw).select(F.lit(True).alias("rejected"), F.col("list_url").cast("bigint").alias("id"))
    return kept.unionByName(gone).groupBy("rejected").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


# --- alerts, keys, labels -------------------------------------------------------


@query("alert_requests", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'none' WHEN o_custkey % 3 = 0 THEN 'unverified' WHEN o_orderkey % 100 NOT BETWEEN 1 AND 90 THEN 'out_of_range' ELSE 'accepted' END AS verdict
FROM orders""")
def alert_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = B.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 100).alias("alert_pct")
    )
    users = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 3 != 0, F.current_timestamp()).alias("verified_at"))
    return AL.armed(saved, users).select("id", "verdict")


@query("email_keys", "SELECT lower(trim(CASE WHEN c_custkey % 2 = 0 THEN '  ' || upper(c_name) || '@X.IO ' ELSE c_name || '@x.io' END)) AS email, count(*) AS n FROM customer GROUP BY 1")
def email_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    given = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("  "), F.upper(name), F.lit("@X.IO "))).otherwise(F.concat(name, F.lit("@x.io")))
    return B.table(spark, sf_dir, "customer").groupBy(email_key(given).alias("email")).agg(F.count(F.lit(1)).alias("n"))


_KEYS = "lower(replace(p_brand, '#', '')) || '/' || CASE p_partkey % 4 WHEN 0 THEN 'A b' WHEN 1 THEN '' ELSE 'x-1' END || '/base/mt/1400/' || CASE WHEN p_partkey % 5 = 0 THEN '0/1' ELSE 'na' END"


@query("valid_keys", f"SELECT p_partkey, regexp_full_match({_KEYS}, '[a-z0-9-]+(/[a-z0-9-]+){{5}}') AS valid FROM part")
def valid_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    model = F.when(k % 4 == 0, "A b").when(k % 4 == 1, "").otherwise("x-1")
    key = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), model, F.lit("/base/mt/1400/"), F.when(k % 5 == 0, "0/1").otherwise("na"))
    return B.table(spark, sf_dir, "part").select("p_partkey", valid_key(key).alias("valid"))


@query("display_names", """WITH p AS (SELECT p_partkey, p_brand AS brand, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ' ' || p_type ELSE p_type END AS model,
  CASE p_partkey % 4 WHEN 0 THEN 'base' WHEN 1 THEN lower(p_type) ELSE 'plus' END AS trim FROM part),
m AS (SELECT *, CASE WHEN model = brand THEN '' WHEN starts_with(model, brand || ' ') THEN substr(model, length(brand) + 2) ELSE model END AS model_name FROM p)
SELECT p_partkey, model_name, CASE WHEN trim <> 'base' AND NOT contains(model_name, upper(trim)) THEN trim END AS trim_name FROM m""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, brand, kind = F.col("p_partkey"), F.col("p_brand"), F.col("p_type")
    model = F.when(k % 3 == 0, brand).when(k % 3 == 1, F.concat(brand, F.lit(" "), kind)).otherwise(kind)
    trim = F.when(k % 4 == 0, "base").when(k % 4 == 1, F.lower(kind)).otherwise("plus")
    rows = B.table(spark, sf_dir, "part").select("p_partkey", display_model(model, brand).alias("model_name"), trim.alias("_trim"))
    return rows.select("p_partkey", "model_name", display_trim(F.col("_trim"), F.array(F.lit(""), F.upper("_trim")), F.col("model_name")).alias("trim_name"))


# Words in titles that decide four findings.
_TITLES = ("حواله پراید", "پراید اقساطی", "پراید فروش سازمانی", "پراید سالم")


@query("title_flags", """SELECT p_partkey, code FROM part, (VALUES (0, 'not_a_car_yet'), (1, 'instalment_price'), (2, 'off_market_sale')) v(i, code) WHERE p_partkey % 4 = i
UNION ALL SELECT p_partkey, 'no_price' FROM part WHERE p_partkey % 5 = 0""")
def title_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    title = F.element_at(F.array(*[F.lit(t) for t in _TITLES]), (k % 4 + 1).cast("int"))
    price = F.when(k % 5 != 0, F.lit(900_000_000))
    flags = record_flags(FlagRules(), F.lit(1000), F.lit(1404), F.lit("x"), title, price)
    rows = B.table(spark, sf_dir, "part").select("p_partkey", flags.alias("flags"))
    return flag_rows(rows, ["p_partkey"]).select("p_partkey", "code")


# --- keeping tables sound --------------------------------------------------------


@query("quarantined_history", """SELECT event_id, CASE WHEN event_id % 6 = 0 OR value <= 20 THEN 'aside' ELSE 'kept' END AS place FROM events""")
def quarantined_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points without a time (a NULL verdict) or with a small value are set aside, none is lost."""
    rows = B.table(spark, sf_dir, "events").select("event_id", "value", F.when(F.col("event_id") % 6 != 0, F.col("ts")).alias("t"))
    sound = F.when(F.col("t").isNotNull(), F.col("value") > 20)
    good, aside = M.quarantine(rows, sound)
    return good.select("event_id", F.lit("kept").alias("place")).unionByName(aside.select("event_id", F.lit("aside").alias("place")))


@query("relabelled_sources", """SELECT CASE p_partkey % 5 WHEN 0 THEN 'landing' WHEN 1 THEN 'landing' WHEN 2 THEN 'landing' ELSE p_brand END AS label, count(*) AS n FROM part GROUP BY 1""")
def relabelled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty, overlong and unprintable labels are replaced; padded ones are trimmed."""
    k, brand = F.col("p_partkey"), F.col("p_brand")
    given = F.when(k % 5 == 0, "  ").when(k % 5 == 1, F.repeat(brand, F.lit(9))).when(k % 5 == 2, F.concat(brand, F.lit("\u0007x"))).when(k % 5 == 3, F.concat(F.lit(" "), brand, F.lit("\t"))).otherwise(brand)
    rows = B.table(spark, sf_dir, "part").select(given.alias("label"))
    return M.relabel(rows, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("damaged_index", f"""WITH {LISTINGS} SELECT source, source_id, CASE WHEN price % 3 = 0 THEN 'fresh' ELSE 'stored' END AS origin FROM listings WHERE price % 2 = 0 OR price % 3 = 0""")
def damaged_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index whose offers cannot be addressed takes no stored detail away."""
    rows = stored(listings(spark, sf_dir).select("source", "source_id", "price"), "damaged")
    held = rows.where("price % 2 = 0").select("source", "source_id", F.lit("stored").alias("origin"))
    fresh = rows.where("price % 3 = 0").select("source", "source_id", F.lit("fresh").alias("origin"))
    broken = rows.select("source", F.lit(None).cast("string").alias("source_id"))
    return M.merge_details(held, fresh, broken)


@query("published_cards", f"WITH {CARDS} SELECT spec_key, offer_count FROM cards")
def published_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions are published; readers get the second, whole."""
    root = f"{shared_dir(spark)}/offerlens/published-{uuid.uuid4().hex}"
    held = card_store(spark, sf_dir).select("spec_key", "offer_count")
    E.publish(held.where("offer_count > 2"), root, "cards")
    E.publish(held, root, "cards")
    return E.published(spark, root, "cards")


# --- served details ---------------------------------------------------------------


@query("detail_capped", """SELECT doc_id, length(text[1:4000]) AS text_size, md5(left(lang, 200)) AS color, least(n_chars % 40, 8) AS n_images, n_chars % 3 = 0 AS has_report FROM documents""")
def detail_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as sellers' texts, with long lists and oversized reports."""
    from offerlens.operators import details as D

    text = F.lit(None).cast("string")
    n = (F.col("n_chars") % 40).cast("int")
    rows = B.table(spark, sf_dir, "documents").select(
        "doc_id", *[(F.col("text") if f == "description" else F.col("lang") if f == "color" else text).alias(f) for f in D.TEXT_FIELDS],
        F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.lit("https://i/"), i.cast("string"))).alias("_images"), n.alias("_n"),
        F.create_map(F.lit("k"), F.col("lang")).alias("extras"),
        F.when(F.col("n_chars") % 3 == 0, F.lit("{}")).otherwise(F.repeat(F.lit("x"), F.lit(D.MAX_INSPECTION + 1))).alias("inspection"),
    )
    shown = capped(rows.withColumn("images", F.slice("_images", F.lit(1), F.col("_n"))))
    return shown.select("doc_id", F.length("description").alias("text_size"), F.md5("color").alias("color"), F.size("images").alias("n_images"), F.col("inspection").isNotNull().alias("has_report"))


@query("inspection_parts", """SELECT p_partkey, p_name AS title, CAST(p_size AS DOUBLE) AS score, CASE WHEN p_partkey % 2 = 0 THEN 'bent' END AS note, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 2 = 0 THEN 1 ELSE 0 END AS n_parts FROM part""")
def inspection_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report per part: perfect parts without a note are left out."""
    k = F.col("p_partkey")
    note = F.when(k % 2 == 0, F.array(F.struct(F.lit(" bent ").alias("text")))).otherwise(F.array(F.struct(F.lit("").alias("text"))))
    one = F.struct(F.lit("door").alias("title"), (k % 3 != 0).alias("isPerfect"), F.struct(note.alias("conditionDescription")).alias("condition"))
    section = F.struct(F.lit("body").alias("key"), F.lit("B").alias("title"), F.col("p_size").cast("double").alias("score"), F.array(one).alias("parts"))
    report = F.to_json(F.struct(F.col("p_name").alias("reportTitle"), F.array(section).alias("collections"), F.array(F.lit("")).alias("damagedParts")))
    told = B.table(spark, sf_dir, "part").select("p_partkey", F.parse_json(inspection(F.parse_json(report))).alias("v"))
    return told.select(
        "p_partkey", F.try_variant_get("v", "$.title", "string").alias("title"), F.try_variant_get("v", "$.sections[0].score", "double").alias("score"),
        F.try_variant_get("v", "$.parts[0].note", "string").alias("note"), F.size(F.try_variant_get("v", "$.parts", "array<variant>")).alias("n_parts"),
    )
