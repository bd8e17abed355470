"""Queries over text, pages, payloads and free-text queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions.text import (
    ASCII_DIGITS, FOREIGN_DIGITS, clean_prose, fold_text, ip_prefix, redact_phones,
)
from offerlens.functions.urls import url_parts
from offerlens.functions.vocabulary import Alias, Vocabulary
from offerlens.operators import intents as I
from offerlens.operators import ranking
from offerlens.operators.cards import cards, unseen
from offerlens.operators.conform import conform
from offerlens.operators.details import extract_details
from offerlens.operators.quality import evaluate, evaluation_counts, evaluation_failures
from offerlens.operators.resolve import match_large_dictionary, resolve
from offerlens.plans import bindings as B
from offerlens.plans.index import CARD_DIMS, indexed, labelled, latest_records, resolved_listings
from offerlens.plans.offer_queries import CARDS, SCALE, WEIGHTS, card_store, score_sql
from offerlens.plans.registry import query
from offerlens.plans.store import stored
from offerlens.sources import captures as S

FA = FOREIGN_DIGITS[:10]

# --- raw feeds derived from the line items ---------------------------------

NAMES = ("divar", "bama", "hamrah", "khodro45", "sheypoor")


def _fa(c: Column) -> Column:
    return F.translate(c.cast("string"), ASCII_DIGITS[:10], FA)


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item published by one of five sources in its own shape and unit."""
    line = B.dealt(B.table(spark, sf_dir, "lineitem"), "l_partkey").join(B.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    source = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("l_orderkey") % 5 + 1).cast("int"))
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber")
    toman = F.round(F.col("l_extendedprice") * 1000).cast("bigint")
    km = ((F.col("l_quantity") - 1) * 5000).cast("bigint")
    year = F.year("l_shipdate")
    worn, even = F.col("l_returnflag"), F.col("l_suppkey") % 2 == 0
    damage = F.when(worn == "R", "half-paint").when(worn == "A", "intact").otherwise("accidental")
    gear = F.when(even, "manual").otherwise("automatic")
    st = lambda **kv: F.struct(*[v.alias(k) for k, v in kv.items()])
    lit = F.lit
    json_of = F.try_parse_json
    quoted = lambda c: F.concat(lit('"'), c.cast("string"), lit('"'))
    shapes = {
        "divar": st(
            name=F.col("p_name"), brand=st(name=F.col("p_brand")), model=F.col("p_type"),
            # Text, the number 0 and nothing at the first path; a second path that differs.
            productionDate=json_of(F.when(F.col("l_suppkey") % 5 == 3, lit("0")).when(even, quoted(year - 621))),
            vehicleModelDate=json_of(F.when(even, (year + 1).cast("string")).otherwise(quoted(year))),
            mileageFromOdometer=st(value=json_of(F.when(F.col("l_suppkey") % 7 == 2, quoted(km)).otherwise(km.cast("string")))), offers=st(price=toman * 10 + 3), color=F.col("l_linestatus"),
            knownVehicleDamages=damage, vehicleTransmission=gear, vehicleIdentificationNumber=lit("VIN"), description=lit("call"),
            web_info=st(city_persian=lit("تهران"), district_persian=lit("x")), image=lit("https://i/1.jpg"),
            url=F.concat(lit("https://divar.ir/v/title/"), ident, lit("/")),
        ),
        "bama": st(
            detail=st(
                title=F.col("p_name"), brand_fa=F.when(even, F.col("p_brand")), brand=F.col("p_type"), trim=F.col("l_linestatus"), year=_fa(year - 621),
                mileage=F.when(km == 0, "صفر کیلومتر").otherwise(F.concat(_fa(km), lit(" km"))),
                body_color=lit(""), body_status=F.when(worn == "R", "گلگیر تعویض").when(worn == "A", "بدون رنگ"),
                transmission=F.when(even, "دنده ای").otherwise("اتوماتیک"), location=lit("تهران / ونک"), url=F.concat(lit("/car/detail-"), ident), code=ident,
                description=lit("call"),
            ),
            price=st(price=F.format_number(toman, 0), type=F.when(F.col("l_suppkey") % 7 == 0, "installment").otherwise("lumpsum")),
        ),
        "hamrah": st(
            orderId=ident, carNamePersian=F.col("p_name"), brandEnglishName=F.col("p_brand"), modelEnglishName=F.col("p_type"),
            carTypeName=F.col("l_linestatus"), carYear=year - 621, km=km, price=toman, carColorName=worn,
            gearBoxPersian=F.when(even, "دنده‌ای").otherwise("اتوماتیک"), carLocation=lit("کرج، البرز"),
            exhibitionDetailUrl=F.concat(lit("/c/"), ident), imageUrl=lit("https://i/2.jpg"),
        ),
        "khodro45": st(
            car_properties=st(
                brand=st(title=lit("ب"), title_en=F.col("p_brand")), model=st(title=F.col("p_name")),
                trim=F.when(even, "دنده‌ای").otherwise("اتوماتیک توربو"), year=year - 621,
            ),
            car_specifications=st(klm=km, is_klm_matched=F.when(worn == "A", True).when(worn == "R", False)), price=toman,
            city=st(title=lit("شیراز")), slug=F.when(even, ident), identifier=ident, image=st(url=lit("https://i/3.jpg")),
        ),
        "sheypoor": st(
            name=F.col("p_name"), brand=st(name=F.col("p_brand")), vehicleModelDate=F.when(even, year - 621).otherwise(year),
            mileageFromOdometer=st(value=json_of(F.when(F.col("l_suppkey") % 7 == 1, F.concat(F.floor(km / 1000).cast("string"), lit(".5"))).otherwise(km.cast("string")))),
            offers=st(Price=toman * 10 + 3, sku=ident), color=worn, knownVehicleDamages=damage,
            vehicleTransmission=gear, url=F.concat(lit("https://sheypoor.com/v/x-"), ident, lit(".html")),
            image=F.array(st(contentUrl=lit("https://i/4.jpg")), st(contentUrl=lit("https://i/5.jpg"))), sheypoor_city_fa=lit("قم"),
        ),
    }
    payload = None
    for name, shape in shapes.items():
        hit = F.col("source") == name
        payload = F.when(hit, F.to_json(shape)) if payload is None else payload.when(hit, F.to_json(shape))
    fetched = F.timestamp_add("SECOND", (F.col("l_partkey") * 60 + F.col("l_linenumber")).cast("int"), F.col("l_shipdate"))
    line = line.withColumn("source", source)
    return line.select("source", F.lit(None).cast("string").alias("city"), F.lit("list").alias("list_url"), fetched.alias("fetched_at"), payload.alias("payload"), F.col("l_suppkey").alias("tie"))


FEED = """b AS (SELECT ['divar', 'bama', 'hamrah', 'khodro45', 'sheypoor'][l_orderkey % 5 + 1] AS source,
  l_orderkey || '-' || l_linenumber AS id, CAST(round(l_extendedprice * 1000) AS BIGINT) AS toman, CAST((l_quantity - 1) * 5000 AS BIGINT) AS km,
  year(l_shipdate) AS y, l_returnflag AS worn, l_suppkey % 2 = 0 AS even,
  CAST(l_orderkey % 5 = 0 AND l_suppkey % 2 = 0 AND l_suppkey % 5 = 3 AS INTEGER) AS later, l_suppkey, l_linestatus, p_name, p_brand, p_type, l_shipdate + to_seconds(l_partkey * 60 + l_linenumber) AS fetched_at, l_suppkey AS tie FROM lineitem JOIN part ON l_partkey = p_partkey)"""
CONFORMED = """SELECT source, id AS source_id, CASE WHEN source = 'khodro45' THEN 'ب ' || p_name ELSE p_name END AS title,
  CASE WHEN source = 'bama' THEN CASE WHEN even THEN p_brand ELSE p_type END ELSE p_brand END AS brand_raw,
  CASE source WHEN 'sheypoor' THEN NULL WHEN 'khodro45' THEN p_name ELSE p_type END AS model_raw,
  CASE source WHEN 'bama' THEN l_linestatus WHEN 'hamrah' THEN l_linestatus WHEN 'khodro45' THEN CASE WHEN even THEN 'دنده‌ای' ELSE 'اتوماتیک توربو' END END AS trim_raw,
  y + later - 621 AS year_jalali, y + later AS year_gregorian,
  CASE WHEN source = 'sheypoor' AND l_suppkey % 7 = 1 THEN (km // 1000) * 10 + 5 WHEN km > 0 OR source IN ('bama', 'khodro45') OR (source = 'divar' AND l_suppkey % 7 = 2) THEN km END AS mileage_km,
  CASE WHEN toman >= 10000000 AND NOT (source = 'bama' AND l_suppkey % 7 = 0) THEN toman END AS price_toman,
  CASE source WHEN 'divar' THEN l_linestatus WHEN 'bama' THEN '' WHEN 'hamrah' THEN worn WHEN 'sheypoor' THEN worn END AS colour,
  CASE WHEN source IN ('divar', 'sheypoor') THEN CASE worn WHEN 'R' THEN 'رنگ‌شدگی' WHEN 'A' THEN 'بدون رنگ' ELSE 'تصادفی' END
    WHEN source = 'bama' THEN CASE worn WHEN 'R' THEN 'تعویض' WHEN 'A' THEN 'بدون رنگ' END END AS body_status,
  CASE WHEN even THEN 'دنده‌ای' ELSE 'اتوماتیک' END AS transmission,
  CASE source WHEN 'divar' THEN 'تهران' WHEN 'bama' THEN 'تهران' WHEN 'hamrah' THEN 'کرج' WHEN 'khodro45' THEN 'شیراز' ELSE 'قم' END AS city,
  CASE source WHEN 'divar' THEN 'https://divar.ir/v/title/' || id || '/' WHEN 'bama' THEN 'https://bama.ir/car/detail-' || id
    WHEN 'hamrah' THEN 'https://www.hamrah-mechanic.com/c/' || id WHEN 'sheypoor' THEN 'https://sheypoor.com/v/x-' || id || '.html'
    ELSE CASE WHEN even THEN 'https://khodro45.com/used-car/' || id || '/' ELSE 'https://khodro45.com/used-car/' END END AS url,
  CASE source WHEN 'divar' THEN 'https://i/1.jpg' WHEN 'hamrah' THEN 'https://i/2.jpg' WHEN 'khodro45' THEN 'https://i/3.jpg' WHEN 'sheypoor' THEN 'https://i/4.jpg' END AS image,
  CASE WHEN source = 'khodro45' THEN CASE worn WHEN 'A' THEN true WHEN 'R' THEN false END END AS km_verified FROM b"""


@query("conform_sources", f"WITH {FEED} {CONFORMED}")
def conform_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(S.envelope(raw_feed(spark, sf_dir), parsed="parsed"), parsed="parsed").drop("fetched_at")


@query("scrubbed_captures", """SELECT ['divar', 'bama', 'hamrah', 'khodro45', 'sheypoor'][l_orderkey % 5 + 1] AS source,
  l_orderkey || '-' || l_linenumber AS source_id, 16 AS hash_length, false AS leaks FROM lineitem JOIN part ON l_partkey = p_partkey""")
def scrubbed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored_rows = S.envelope(raw_feed(spark, sf_dir))
    leaks = F.col("payload").contains("description") | F.col("payload").contains("VIN") | F.col("payload").contains("district_persian")
    return stored_rows.select("source", "source_id", F.length("content_hash").alias("hash_length"), leaks.alias("leaks"))


@query("content_hash_new_rows", """WITH h AS (SELECT event_type AS source, user_id AS source_id, left(sha256(props), 16) AS content_hash, ts FROM events)
SELECT DISTINCT source, source_id, content_hash FROM h WHERE ts >= TIMESTAMP '2024-01-16' AND NOT EXISTS (SELECT 1 FROM h o
  WHERE o.ts < TIMESTAMP '2024-01-16' AND o.source = h.source AND o.source_id = h.source_id AND o.content_hash = h.content_hash)""")
def content_hash_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"), F.col("user_id").alias("source_id"),
        F.left(F.sha2("props", 256), F.lit(16)).alias("content_hash"), "ts",
    )
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    keys = ["source", "source_id", "content_hash"]
    return unseen(events.where(F.col("ts") >= cut).select(*keys), events.where(F.col("ts") < cut).select(*keys))


# --- records inside pages ---------------------------------------------------


@query("page_records", """SELECT ['divar', 'hamrah', 'sheypoor'][p_partkey % 3 + 1] AS source, p_partkey || '-' || i AS source_id,
  CASE WHEN p_partkey % 3 = 2 THEN 'تهران' END AS city_name, p_name || ' ' || i AS title
FROM part, (VALUES (0), (1)) v(i)""")
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List pages built from parts: two listings a page, with banners and other blocks."""
    part = B.dealt(B.table(spark, sf_dir, "part"), "p_partkey")
    ident = lambda i: F.concat(F.col("p_partkey").cast("string"), F.lit(f"-{i}"))
    title = lambda i: F.concat("p_name", F.lit(f" {i}"))
    car = lambda i: F.struct(F.lit("Car").alias("@type"), title(i).alias("name"), F.concat(F.lit("https://d/v/x/"), ident(i)).alias("url"))
    vehicle = lambda i: F.struct(F.lit("Vehicle").alias("@type"), title(i).alias("name"), F.struct(ident(i).alias("sku")).alias("offers"))
    banner = F.lit('{"@type":"Offer","name":"banner"}')
    script = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    divar = F.concat(F.lit("<html>"), script(F.lit("{broken")), script(F.to_json(F.array(car(0), car(1)))))
    state = F.struct(F.struct(F.struct(F.struct(F.array(*[
        F.struct(ident(i).alias("orderId"), title(i).alias("carNamePersian")) for i in (0, 1)]).alias("list")).alias("cars")).alias("pageProps")).alias("props"))
    hamrah = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), F.to_json(state), F.lit("</script>"))
    crumbs = F.lit('{"@type":"BreadcrumbList","itemListElement":[{"name":"x","item":"https://s/"},{"item":{"@id":"https://s/s/tehran/","name":"تهران"}}]}')
    listed = F.concat(F.lit('{"mainEntity":{"itemListElement":['), F.to_json(vehicle(0)), F.lit(","), banner, F.lit(","), F.to_json(vehicle(1)), F.lit("]}}"))
    sheypoor = F.concat(script(F.lit('{"@type":"FAQPage"}')), script(crumbs), script(listed))
    kind = F.col("p_partkey") % 3
    pages = part.select(
        F.when(kind == 0, "divar").when(kind == 1, "hamrah").otherwise("sheypoor").alias("source"), F.lit("tehran").alias("city"),
        F.lit("list").alias("list_url"), F.lit(None).cast("timestamp").alias("fetched_at"),
        F.when(kind == 0, divar).when(kind == 1, hamrah).otherwise(sheypoor).alias("body"),
    )
    found = S.envelope(S.listing_records(pages), parsed="_v")
    return found.select(
        "source", "source_id", S.text_at(F.col("_v"), "$.sheypoor_city_fa").alias("city_name"),
        S.text_at(F.col("_v"), "$.name", "$.carNamePersian").alias("title"),
    )


@query("html_title_text", r"""SELECT page_id, trim(regexp_replace(nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ''), '\s+', ' ', 'g')) AS title FROM pages""")
def html_title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "pages").select("page_id", S.page_title(F.col("html")).alias("title"))


@query("url_identity", r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), ':\d*$', ''), '^www\.', '') AS host,
  list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS seg FROM pages)
SELECT page_id, host, CAST(len(seg) AS INTEGER) AS segments, seg[len(seg)] AS last_segment, coalesce(regexp_extract(seg[len(seg)], '([0-9]+)$', 1), '') AS tail FROM p""")
def url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, segments = url_parts(F.col("url"))
    last = F.try_element_at(segments, F.lit(-1))
    tail = F.coalesce(F.regexp_extract(last, "([0-9]+)$", 1), F.lit(""))
    return B.table(spark, sf_dir, "pages").select(
        "page_id", host.alias("host"), F.size(segments).alias("segments"), last.alias("last_segment"), tail.alias("tail")
    )


# --- whole texts ------------------------------------------------------------

BLANK = r"[\t\r\x{0b}\f\x{1c}-\x{1f}\x{85}\p{Z}]"


@query("text_fold", r"""WITH f AS (SELECT doc_id, lower(trim(regexp_replace(translate(text, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩يكةأإآ', '01234567890123456789یکهااا'),
  '[،,/\\|_\-–—\s\x{0b}\x{85}\p{Z}\x{200c}]+', ' ', 'g'))) AS t FROM documents) SELECT doc_id, length(t) AS size, md5(t) AS digest FROM f""")
def text_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = B.table(spark, sf_dir, "documents").select("doc_id", fold_text(F.col("text")).alias("t"))
    return folded.select("doc_id", F.length("t").alias("size"), F.md5("t").alias("digest"))


_SQL_PHONE = r"(^|[^0-9])(?:\+?98|0)[\s.\-]?[0-9](?:[\s.\-]?[0-9]){8,10}($|[^0-9])"
_once = lambda x: f"regexp_replace({x}, '{_SQL_PHONE}', '\\1[شماره تماس حذف شد]\\2', 'g')"
_redacted = lambda x: _once(_once(x))


@query("redact_pii", f"""WITH r AS (SELECT doc_id, {_redacted('text')} AS t FROM documents)
SELECT doc_id, md5(t) AS digest, CAST((length(t) - length(replace(t, '[شماره تماس حذف شد]', ''))) / 19 AS BIGINT) AS cut FROM r""")
def redact_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = "[شماره تماس حذف شد]"
    red = B.table(spark, sf_dir, "documents").select("doc_id", redact_phones(F.col("text")).alias("t"))
    cut = (F.length("t") - F.length(F.replace(F.col("t"), F.lit(tag)))) / len(tag)
    return red.select("doc_id", F.md5("t").alias("digest"), cut.cast("bigint").alias("cut"))


@query("clean_text", rf"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{BLANK.replace("p{Z}", "p{Zs}")}+', ' ', 'g'), '(?m)^ +| +$', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, trim(regexp_replace(t, '\n{{3,}}', E'\n\n', 'g'), E' \n\t') AS t FROM a)
SELECT doc_id, CASE WHEN length(t) >= 2 AND regexp_matches(t, '[\p{{L}}\p{{N}}_]') THEN md5({_redacted('t')}) END AS digest FROM b""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select("doc_id", F.md5(clean_prose(F.col("text"))).alias("digest"))


@query("detail_pages", rf"""WITH a AS (SELECT doc_id, lang, n_chars, regexp_replace(regexp_replace(text, '{BLANK.replace("p{Z}", "p{Zs}")}+', ' ', 'g'), '(?m)^ +| +$', '', 'g') AS t FROM documents),
b AS (SELECT *, trim(regexp_replace(t, '\n{{3,}}', E'\n\n', 'g'), E' \n\t') AS u FROM a)
SELECT ['divar', 'bama', 'sheypoor', 'khodro45', 'hamrah'][doc_id % 5 + 1] AS source, doc_id AS source_id,
  CASE WHEN length(u) >= 2 AND regexp_matches(u, '[\p{{L}}\p{{N}}_]') THEN md5({_redacted('u')}) END AS digest,
  CASE WHEN doc_id % 5 IN (0, 1, 2, 4) THEN lang END AS color, CASE WHEN doc_id % 5 IN (0, 1, 2) THEN 'کارکرده' END AS condition,
  CASE WHEN doc_id % 5 IN (1, 2, 3, 4) THEN 'سدان' END AS body, CASE WHEN doc_id % 5 IN (0, 1, 2, 3) THEN 2 ELSE 1 END AS n_images FROM b""")
def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail pages whose seller text is a whole document, read back by the extractors."""
    doc = B.dealt(B.table(spark, sf_dir, "documents"), "doc_id")
    safe = F.replace(F.col("text"), F.lit("</script"), F.lit("<\\/script"))
    st = lambda **kv: F.struct(*[v.alias(k.replace("type_", "@type")) for k, v in kv.items()])
    lit = F.lit
    script = lambda body: F.concat(lit('<html><script type="application/ld+json">'), body, lit("</script></html>"))
    photos = ("https://i/p/a.jpg", "https://i/webp/a.webp", "https://i/p/b.jpg", "relative/c.jpg")
    used = lit("https://schema.org/UsedCondition")
    cdn = "".join(f'<img src="https://x.divarcdn.com/static/photo/{p}">' for p in ("webp_thumbnail/t/a.webp", "post/u/b.jpg"))
    divar = F.concat(script(F.to_json(F.array(st(type_=lit("Car"), description=safe, color=F.col("lang"), itemCondition=used, image=lit("https://i/p/a.jpg"))))), lit(cdn))
    graph = lit('<script type="application/ld+json">{"@graph":[{"@type":"ImageObject","contentUrl":"https://i/q/b.jpg"},{"@type":"X"}]}</script>')
    bama = F.concat(script(F.to_json(st(
        type_=F.array(lit("Product"), lit("Car")), description=F.concat(lit("خرید خودرو الف در شهر تهران، "), safe), color=F.col("lang"),
        itemCondition=used, bodyType=lit("Sedan"), image=lit("https://i/p/a.jpg")))), graph)
    sheypoor = script(F.to_json(st(mainEntity=st(
        description=safe, color=F.col("lang"), itemCondition=used, bodyType=lit("sedan"), image=F.array(*[st(contentUrl=lit(p)) for p in photos])))))
    k45 = F.to_json(st(car_specifications=st(additional_information=safe, body_type=lit("sedan")), car_images=F.array(*[st(image=st(url=lit(p))) for p in photos])))
    spec = lambda k, v: st(key=lit(k), title=lit("t"), value=v)
    hamrah = F.concat(lit('<script id="__NEXT_DATA__" type="application/json">'), F.to_json(st(props=st(pageProps=st(
        orderDetails=st(carSpecifications=st(specs=F.array(spec("color", F.col("lang")), spec("bodyType", lit("sedan")))),
                        descriptionPart=st(description=F.concat(lit("این خودرو توسط همراه مکانیک کارشناسی شده است و ضمانت دارد. "), safe))),
        gallery=F.array(st(largeImage=lit("https://i/p/a.jpg"))))))), lit("</script>"))
    at = F.col("doc_id") % 5
    pages = doc.select(
        F.element_at(F.array(*[lit(n) for n in ("divar", "bama", "sheypoor", "khodro45", "hamrah")]), (at + 1).cast("int")).alias("source"),
        F.col("doc_id").alias("source_id"), lit(None).cast("timestamp").alias("fetched_at"),
        F.when(at == 0, divar).when(at == 1, bama).when(at == 2, sheypoor).when(at == 3, k45).otherwise(hamrah).alias("body"),
    )
    rows = extract_details(pages)
    return rows.select("source", "source_id", F.md5("description").alias("digest"), "color", "condition", "body", F.size("images").alias("n_images"))


# --- entity resolution ------------------------------------------------------

NOUNS = ("ring", "rod", "bolt", "gear", "gizmo", "plate", "widget", "anvil")
_BRANDS = (("promo", "promo"), ("tone", "blue"), ("tone", "red"), ("heat", "hot"), ("heat", "cold"),
           ("size", "large"), ("size", "small"), ("age", "old"), ("age", "new"))
_MODELS = (("promo", "one", "1"), ("promo", "two", "2"), ("promo", "twelve", "12"), ("tone", "blue-ring", "blue ring"),
           *[(b, n, n) for b in ("tone", "heat", "size", "age") for n in NOUNS if n != "gizmo"])
_TRIMS = (("metal", "rod"), ("metal", "bolt"), ("toy", "widget"), ("toy", "gizmo"))
PART_VOCAB = Vocabulary(
    tuple(Alias(s, a, i) for i, (s, a) in enumerate(_BRANDS)),
    tuple(Alias(s, a, i, b) for i, (b, s, a) in enumerate(_MODELS)),
    tuple(Alias(s, a, i) for i, (s, a) in enumerate(_TRIMS)),
)
_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
DICTIONARY = f"""brands(slug, alias, ord) AS (VALUES {_values([(s, a, i) for i, (s, a) in enumerate(_BRANDS)])}),
models(brand, slug, alias, ord) AS (VALUES {_values([(b, s, a, i) for i, (b, s, a) in enumerate(_MODELS)])}),
trims(slug, alias, ord) AS (VALUES {_values([(s, a, i) for i, (s, a) in enumerate(_TRIMS)])})"""


def resolved_sql(id_: str) -> str:
    """Longest matches over a table ``texts`` with a text ``t``."""
    best = f"QUALIFY row_number() OVER (PARTITION BY {id_} ORDER BY length(alias) DESC, ord) = 1"
    return f"""{DICTIONARY},
b AS (SELECT {id_}, slug FROM texts JOIN brands ON contains(t, alias) {best}),
m AS (SELECT {id_}, models.slug FROM texts JOIN b USING ({id_}) JOIN models ON models.brand = b.slug
  AND CASE WHEN regexp_matches(alias, '^[0-9]+$') THEN regexp_matches(t, '(^|[^0-9])' || alias || '($|[^0-9])') ELSE contains(t, alias) END {best}),
tr AS (SELECT {id_}, slug FROM texts JOIN trims ON contains(t, alias) {best})"""


RESOLVED = "texts AS (SELECT p_partkey, lower(p_brand || ' ' || p_type || ' ' || p_name) AS t FROM part), " + resolved_sql("p_partkey")


@query("title_resolution", f"""WITH {RESOLVED} SELECT p_partkey, b.slug AS brand, m.slug AS model, CASE WHEN b.slug IS NOT NULL THEN tr.slug END AS trim,
  CASE WHEN m.slug IS NOT NULL AND tr.slug IS NOT NULL THEN 0.95 WHEN m.slug IS NOT NULL THEN 0.85 WHEN b.slug IS NOT NULL THEN 0.45 ELSE 0 END::DOUBLE AS confidence,
  CASE WHEN m.slug IS NOT NULL THEN 'rules' ELSE 'unresolved' END AS method
FROM texts LEFT JOIN b USING (p_partkey) LEFT JOIN m USING (p_partkey) LEFT JOIN tr USING (p_partkey)""")
def title_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve(B.table(spark, sf_dir, "part"), PART_VOCAB, ["p_brand", "p_type", "p_name"])
    return rows.select("p_partkey", "resolution.brand", "resolution.model", "resolution.trim", "resolution.confidence", "resolution.method")


@query("large_dictionary_match", """WITH d AS (SELECT DISTINCT lower(p_name) AS alias, lower(p_name) AS slug FROM part),
texts AS (SELECT p_partkey, lower(p_brand || ' ' || p_name || ' ' || p_type) AS t FROM part)
SELECT p_partkey, slug FROM texts LEFT JOIN d ON contains(t, alias) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(alias) DESC, slug) = 1""")
def large_dictionary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = B.table(spark, sf_dir, "part")
    words = part.select(F.lower("p_name").alias("alias"), F.lower("p_name").alias("slug"), F.lit(0).alias("ord")).distinct()
    texts = part.select("p_partkey", F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("t"))
    return match_large_dictionary(texts, "t", words).select("p_partkey", "slug")


@query("dictionary_resolution", """WITH p AS (SELECT p_partkey, lower(p_brand) AS b, lower(p_name) AS n, lower(p_type) AS k FROM part),
d AS (SELECT DISTINCT 'model' AS kind, b AS brand, n || '-' || k AS slug, unnest([n || ' ' || k, k || ' ' || n, n || ' ' || p_partkey]) AS alias, 1 AS ord FROM p
  UNION ALL SELECT DISTINCT 'brand', '', b, b, 0 FROM p UNION ALL SELECT DISTINCT 'trim', '', k, k, 0 FROM p),
texts AS (SELECT p_partkey, lower(p_brand || ' ' || p_name || ' ' || CASE WHEN p_partkey % 3 = 0 THEN '' || p_partkey ELSE p_type END) AS t FROM part),
hits AS (SELECT p_partkey, d.* FROM texts JOIN d ON contains(t, alias)),
b AS (SELECT p_partkey, slug FROM hits WHERE kind = 'brand' QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(alias) DESC, ord, slug) = 1),
m AS (SELECT h.p_partkey, h.slug FROM hits h JOIN b ON b.p_partkey = h.p_partkey AND h.brand = b.slug WHERE kind = 'model' QUALIFY row_number() OVER (PARTITION BY h.p_partkey ORDER BY length(alias) DESC, ord, h.slug) = 1),
tr AS (SELECT p_partkey, slug FROM hits WHERE kind = 'trim' QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(alias) DESC, ord, slug) = 1)
SELECT p_partkey, b.slug AS brand, m.slug AS model, CASE WHEN b.slug IS NOT NULL THEN tr.slug END AS trim FROM texts LEFT JOIN b USING (p_partkey) LEFT JOIN m USING (p_partkey) LEFT JOIN tr USING (p_partkey)""")
def dictionary_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles against a dictionary with three brand-dependent aliases for every part."""
    part = B.table(spark, sf_dir, "part")
    b, n, k = F.lower("p_brand"), F.lower("p_name"), F.lower("p_type")
    aliases = F.array(F.concat_ws(" ", n, k), F.concat_ws(" ", k, n), F.concat_ws(" ", n, F.col("p_partkey").cast("string")))
    models = part.select(F.lit("model").alias("kind"), b.alias("brand"), F.concat_ws("-", n, k).alias("slug"), F.explode(aliases).alias("alias"), F.lit(1).alias("ord"))
    single = lambda kind, c: part.select(F.lit(kind).alias("kind"), F.lit("").alias("brand"), c.alias("slug"), c.alias("alias"), F.lit(0).alias("ord"))
    words = models.unionByName(single("brand", b)).unionByName(single("trim", k)).distinct()
    last = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey").cast("string")).otherwise(F.col("p_type"))
    rows = resolve(part.select("p_partkey", "p_brand", "p_name", last.alias("last")), words, ["p_brand", "p_name", "last"])
    return rows.select("p_partkey", "resolution.brand", "resolution.model", "resolution.trim")


INDEX_SQL = f"""WITH {FEED}, conf AS ({CONFORMED.replace("FROM b", ", fetched_at, tie FROM b")}),
latest AS (SELECT * FROM conf QUALIFY row_number() OVER (PARTITION BY source, source_id ORDER BY fetched_at DESC, tie) = 1),
texts AS (SELECT source || '|' || source_id AS id, lower(concat_ws(' ', brand_raw, model_raw, trim_raw, title)) AS t FROM latest), {resolved_sql("id").replace("b AS (", "bb AS (").replace("JOIN b USING", "JOIN bb USING").replace("b.slug", "bb.slug")},
o AS (SELECT l.*, bb.slug || '/' || m.slug || '/' || coalesce(tr.slug, 'base') || '/' || CASE transmission WHEN 'اتوماتیک' THEN 'at' ELSE 'mt' END || '/' || year_jalali || '/' || coalesce(CAST(mileage_km // 25000 AS VARCHAR), 'na') AS spec_key,
  CAST(coalesce(mileage_km = 0, false) AS INT) + CAST(coalesce(mileage_km = 0 AND body_status IN ('رنگ‌شدگی', 'تمام‌رنگ', 'تعویض'), false) AS INT) AS nflags
  FROM latest l JOIN bb ON bb.id = l.source || '|' || l.source_id JOIN m ON m.id = bb.id LEFT JOIN tr ON tr.id = bb.id WHERE price_toman IS NOT NULL),
md AS (SELECT spec_key, CAST(floor(median(price_toman)) AS BIGINT) AS mp, count(*) AS n FROM o GROUP BY 1),
f AS (SELECT o.*, mp, n, nflags + CAST(n >= 3 AND (price_toman * 5 < mp * 2 OR price_toman * 2 > mp * 5) AS INT) AS allflags FROM o JOIN md USING (spec_key))
SELECT spec_key, first(mp) AS median_price, count(*) AS offer_count, count(DISTINCT source) AS source_count, CAST(sum(allflags) AS BIGINT) AS flag_count,
  coalesce(min(price_toman) FILTER (allflags = 0), min(price_toman)) AS min_price, coalesce(max(price_toman) FILTER (allflags = 0), max(price_toman)) AS max_price FROM f GROUP BY 1"""


@query("index_build", INDEX_SQL)
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five raw feeds to cards: capture, dedupe, conform, resolve, flag, aggregate."""
    captures = S.envelope(raw_feed(spark, sf_dir), ("tie",))
    listings = stored(resolved_listings(captures, PART_VOCAB, ties=[F.asc("tie")]), "listings")
    found = labelled(cards(indexed(listings), dims=CARD_DIMS), PART_VOCAB)
    return found.select("spec_key", "median_price", "offer_count", "source_count", "flag_count", "min_price", "max_price")


@query("listing_origins", INDEX_SQL[: INDEX_SQL.index("texts AS")].rstrip().rstrip(",") + " SELECT source, source_id, brand_raw AS raw_brand, model_raw AS raw_model, trim_raw AS raw_trim FROM latest")
def listing_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources' own words, kept beside the conformed columns of every listing."""
    rows = latest_records(S.envelope(raw_feed(spark, sf_dir), ("tie",)), [F.asc("tie")])
    return rows.select("source", "source_id", *[F.col(f"{x}_raw").alias(f"raw_{x}") for x in ("brand", "model", "trim")])


# --- free-text queries ------------------------------------------------------

QUERY_VOCAB = Vocabulary(
    (Alias("alpha", "alpha", 0), Alias("alpha", "الفا", 1), Alias("beta", "beta", 2), Alias("beta", "بتا", 3)),
    (Alias("206", "206", 0, "alpha"), Alias("206-sd", "206 sd", 1, "alpha"), Alias("x1", "x1", 2, "beta"), Alias("x1", "x 1", 3, "beta")),
)
TEMPLATES = (
    "آلفا 206 زیر {n} میلیون", "بتا x 1 بین {n} تا {m} میلیون", "ارزان‌ترین آلفا بالای مدل {y}", "206 اتوماتیک مدل {j}",
    "بتا دنده‌ای از {n} میلیارد", "beta {g} کم کارکرد", "مدل {y} تا 99 آلفا 206 sd", "بهترین خودرو تا {n}",
    "از {n} میلیون تا {m} میلیون", "alpha {n} x1",
)


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per order, its numbers taken from the order, half in other digits."""
    n = F.floor(F.col("o_totalprice") / 1000).cast("bigint")
    year = F.year("o_orderdate")
    numbers = {"n": n, "m": n + 150, "y": year % 100, "j": year - 621, "g": year}
    text = None
    for i, template in enumerate(TEMPLATES):
        filled = F.lit(template)
        for name, value in numbers.items():
            if f"{{{name}}}" in template:
                filled = F.replace(filled, F.lit(f"{{{name}}}"), F.lpad(value.cast("string"), 2, "0") if name == "y" else value.cast("string"))
        hit = F.col("o_orderkey") % 10 == i
        text = F.when(hit, filled) if text is None else text.when(hit, filled)
    odd = F.floor(F.col("o_orderkey") / 10) % 2 == 1
    return B.dealt(B.table(spark, sf_dir, "orders"), "o_orderkey").select(
        F.col("o_orderkey").alias("query_id"), F.when(odd, _fa(text)).otherwise(text).alias("q"),
        n.alias("n"), year.alias("y"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("latency"),
    )


def _template_sql() -> str:
    whens = []
    for i, t in enumerate(TEMPLATES):
        sql = f"'{t}'"
        for name, value in (("n", "n"), ("m", "n + 150"), ("y", "lpad(CAST(y % 100 AS VARCHAR), 2, '0')"), ("j", "y - 621"), ("g", "y")):
            if f"{{{name}}}" in t:
                sql = f"replace({sql}, '{{{name}}}', CAST({value} AS VARCHAR))"
        whens.append(f"WHEN {i} THEN {sql}")
    return "CASE query_id % 10 " + " ".join(whens) + " END"


_num = lambda pattern, group: f"try_cast(regexp_extract(t, '{pattern}', {group}) AS DOUBLE)"
_yearlike = lambda x: f"({x} = floor({x}) AND ({x} BETWEEN 60 AND 99 OR {x} BETWEEN 1300 AND 1450 OR {x} BETWEEN 1990 AND 2100))"
_scale = lambda x, u: f"CAST(trunc({x} * CASE WHEN {u} = 'میلیارد' THEN 1e9 WHEN {u} = 'میلیون' THEN 1e6 WHEN {x} < 10000 THEN 1e6 ELSE 1.0 END) AS BIGINT)"
_year = lambda x: f"(CASE WHEN {x} BETWEEN 1300 AND 1450 THEN {x} WHEN {x} BETWEEN 60 AND 99 THEN {x} + 1300 WHEN {x} BETWEEN 0 AND 20 THEN {x} + 1400 WHEN {x} BETWEEN 1990 AND 2100 THEN {x} - 621 END)"
_yr = lambda pattern, group=1: _year(f"try_cast(regexp_extract(t, '{pattern}', {group}) AS INTEGER)")
PARSED = f"""q0 AS (SELECT o_orderkey AS query_id, CAST(floor(o_totalprice / 1000) AS BIGINT) AS n, year(o_orderdate) AS y, CAST(round(o_totalprice * 100) AS BIGINT) AS latency FROM orders),
q1 AS (SELECT *, {_template_sql()} AS t FROM q0),
q2 AS (SELECT * REPLACE (lower(trim(regexp_replace(translate(t, 'آ', 'ا'), '[\\s\\x{{200c}}]+', ' ', 'g'))) AS t) FROM q1),
q3 AS (SELECT *, {_num(I.PRICE_RANGE, 1)} AS lo, {_num(I.PRICE_RANGE, 2)} AS hi, regexp_extract(t, '{I.PRICE_RANGE}', 3) AS ru,
  {_num(I.PRICE_CEILING, 1)} AS ce, regexp_extract(t, '{I.PRICE_CEILING}', 2) AS cu, {_num(I.PRICE_FLOOR, 1)} AS fl, regexp_extract(t, '{I.PRICE_FLOOR}', 2) AS fu,
  {_yr(I.YEAR_RANGE, 1)} AS y1, {_yr(I.YEAR_RANGE, 2)} AS y2, {_yr(I.YEAR_FLOOR)} AS yf, {_yr(I.YEAR_EXACT)} AS ye, {_yr(I.YEAR_BARE)} AS yb FROM q2),
q4 AS (SELECT *, CASE WHEN contains(t, 'alpha') THEN 'alpha' WHEN contains(t, 'الفا') THEN 'alpha' WHEN contains(t, 'beta') THEN 'beta' WHEN contains(t, 'بتا') THEN 'beta' END AS b,
  CASE WHEN contains(t, '206 sd') THEN '206-sd' WHEN regexp_matches(t, '(^|[^0-9])206($|[^0-9])') THEN '206' END AS ma,
  CASE WHEN contains(t, 'x1') OR contains(t, 'x 1') THEN 'x1' END AS mb, coalesce(lo > 0 AND hi > 0 AND NOT {_yearlike('lo')}, false) AS rng FROM q3),
parsed AS (SELECT query_id, t, n, y, latency, CASE WHEN b IS NOT NULL THEN b WHEN ma IS NOT NULL THEN 'alpha' WHEN mb IS NOT NULL THEN 'beta' END AS brand,
  CASE WHEN b = 'alpha' THEN ma WHEN b = 'beta' THEN mb ELSE coalesce(ma, mb) END AS model,
  CASE WHEN contains(t, 'اتومات') THEN 'at' WHEN contains(t, 'دنده') THEN 'mt' END AS gearbox,
  CASE WHEN contains(t, 'ارزان') THEN 'cheapest' WHEN contains(t, 'کم کارکرد') THEN 'lowkm' WHEN contains(t, 'بهترین') THEN 'value' ELSE 'relevant' END AS priority,
  CASE WHEN rng THEN {_scale('lo', 'ru')} WHEN fl > 0 THEN {_scale('fl', 'fu')} END AS price_min,
  CASE WHEN rng THEN {_scale('hi', 'ru')} WHEN ce > 0 AND NOT {_yearlike('ce')} THEN {_scale('ce', 'cu')} END AS price_max,
  CASE WHEN y1 <= y2 THEN y1 WHEN yf IS NOT NULL THEN yf WHEN ye IS NOT NULL THEN ye ELSE yb END AS year_min,
  CASE WHEN y1 <= y2 THEN y2 WHEN yf IS NOT NULL THEN NULL WHEN ye IS NOT NULL THEN ye ELSE yb END AS year_max FROM q4)"""
PARSE_FIELDS = ("brand", "model", "gearbox", "priority", "price_min", "price_max", "year_min", "year_max")


def parsed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.parse_queries(query_texts(spark, sf_dir), QUERY_VOCAB)


@query("parse_queries", f"""WITH {PARSED} SELECT query_id, {', '.join(PARSE_FIELDS)}, CASE WHEN model IS NOT NULL AND (year_min IS NOT NULL OR price_max IS NOT NULL) THEN 0.95
  WHEN model IS NOT NULL THEN 0.85 WHEN brand IS NOT NULL THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence FROM parsed""")
def parse_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_queries(spark, sf_dir).select("query_id", *PARSE_FIELDS, "confidence")


_CATALOGUE = """lines AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
brands AS (SELECT DISTINCT s % 40 AS n FROM lines),
asked AS (SELECT o_orderkey AS query_id, o_custkey % 43 AS n, p, s, o_orderkey % 4 AS k FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary with a model alias for every part and supplier that met on a line."""
    lines = B.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct()
    number = lambda c: c.cast("string")
    of = F.concat(F.lit("b"), number(F.col("s") % 40))
    models = lines.select(
        F.lit("model").alias("kind"), of.alias("brand"), F.concat_ws("-", number(F.col("p")), number(F.col("s"))).alias("slug"),
        F.concat_ws(" ", F.lit("mdl"), number(F.col("p")), number(F.col("s"))).alias("alias"), F.lit(1).alias("ord"),
    )
    brands = lines.select(F.lit("brand").alias("kind"), F.lit("").alias("brand"), of.alias("slug"), F.concat(F.lit("مارک"), number(F.col("s") % 40)).alias("alias"), F.lit(0).alias("ord"))
    return models.unionByName(brands.distinct())


def catalogue_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per order: a model of its lines, with its own brand, another one or none."""
    lines = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    rows = B.dealt(B.table(spark, sf_dir, "orders").join(lines, "o_orderkey"), "o_orderkey")
    number = lambda c: c.cast("string")
    k = F.col("o_orderkey") % 4
    brand = F.when(k == 0, F.concat(F.lit("مارک"), number(F.col("s") % 40))).when(k == 1, F.concat(F.lit("مارک"), number(F.col("o_custkey") % 43))).otherwise("خودرو")
    return rows.select(F.col("o_orderkey").alias("query_id"), F.concat_ws(" ", brand, F.lit("MDL"), number(F.col("p")), F.concat(number(F.col("s")), F.when(k == 3, "7").otherwise("")), F.lit("تا ۵۰۰ میلیون")).alias("q"))


@query("parse_large_dictionary", f"""WITH {_CATALOGUE},
named AS (SELECT a.*, CASE k WHEN 0 THEN s % 40 WHEN 1 THEN n END AS said, CAST(s AS VARCHAR) || CASE WHEN k = 3 THEN '7' ELSE '' END AS digits FROM asked a),
b AS (SELECT query_id, n AS brand FROM (SELECT query_id, brands.n, length(CAST(brands.n AS VARCHAR)) AS size FROM named JOIN brands ON starts_with(CAST(said AS VARCHAR), CAST(brands.n AS VARCHAR)))
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY size DESC) = 1),
m AS (SELECT q.query_id, l.p || '-' || l.s AS model, l.s % 40 AS model_brand FROM named q LEFT JOIN b ON b.query_id = q.query_id JOIN lines l ON l.p = q.p AND starts_with(q.digits, CAST(l.s AS VARCHAR)) AND (b.brand IS NULL OR b.brand = l.s % 40)
  QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY length(CAST(l.s AS VARCHAR)) DESC) = 1)
SELECT q.query_id, 'b' || coalesce(b.brand, model_brand) AS brand, model, CAST(500000000 AS BIGINT) AS price_max, CASE WHEN model IS NOT NULL THEN 0.95 WHEN b.brand IS NOT NULL THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence
FROM named q LEFT JOIN b USING (query_id) LEFT JOIN m USING (query_id)""")
def parse_large_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries against tens of thousands of aliases that depend on the brand found."""
    parsed = I.parse_queries(catalogue_queries(spark, sf_dir), stored(catalogue(spark, sf_dir), "catalogue"))
    return parsed.select("query_id", "brand", "model", "price_max", "confidence")


def _override_columns() -> dict[str, Column]:
    k = F.col("o_orderkey")
    pick = lambda test, value: F.when(test, value)
    return {
        "brand": pick(k % 4 == 0, "").when(k % 4 == 1, " beta "), "model": pick(k % 6 == 0, ""), "gearbox": pick(k % 7 == 0, "at"),
        "price_min": pick(k % 8 == 0, "").when(k % 8 == 1, "5000000"), "price_max": pick(k % 9 == 0, "").when(k % 9 == 1, "-5").when(k % 9 == 2, "9000000"),
        "year_min": pick(k % 10 == 0, "abc").when(k % 10 == 1, "1390"), "year_max": pick(k % 11 == 0, ""),
        "sources": pick(k % 5 == 0, "s1, ,s2").when(k % 5 == 1, ""), "multi_only": pick(k % 3 == 0, "1").when(k % 3 == 1, "0"), "unflagged": pick(k % 13 == 0, "1"),
    }


def merged_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), *[c.cast("string").alias(n) for n, c in _override_columns().items()])
    return I.override(parsed_queries(spark, sf_dir), given)


MERGED = f"""{PARSED}, merged AS (SELECT query_id, CASE query_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'beta' ELSE brand END AS brand,
  CASE WHEN query_id % 6 = 0 THEN NULL ELSE model END AS model, CASE WHEN query_id % 7 = 0 THEN 'at' ELSE gearbox END AS gearbox, priority,
  CASE query_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 5000000 ELSE price_min END AS price_min, CASE query_id % 9 WHEN 0 THEN NULL WHEN 2 THEN 9000000 ELSE price_max END AS price_max,
  CASE WHEN query_id % 10 = 1 THEN 1390 ELSE year_min END AS year_min, CASE WHEN query_id % 11 = 0 THEN NULL ELSE year_max END AS year_max,
  CASE WHEN query_id % 5 = 0 THEN 's1,s2' END AS sources, query_id % 3 = 0 AS multi_only, query_id % 13 = 0 AS unflagged FROM parsed)"""
_ACTIVE = """CAST(brand IS NOT NULL AS INT) + CAST(model IS NOT NULL AS INT) + CAST(gearbox IS NOT NULL AS INT) + CAST(price_min IS NOT NULL OR price_max IS NOT NULL AS INT)
  + CAST(year_min IS NOT NULL OR year_max IS NOT NULL AS INT) + CAST(sources IS NOT NULL AS INT) + CAST(multi_only AS INT) + CAST(unflagged AS INT)"""


@query("override_merge", f"WITH {MERGED} SELECT *, {_ACTIVE} AS active FROM merged")
def override_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merged_queries(spark, sf_dir).withColumn("active", I.active_filters())
    return rows.select("query_id", *PARSE_FIELDS, F.array_join("sources", ",").alias("sources"), "multi_only", "unflagged", "active")


@query("relaxed_intents", f"""WITH {MERGED} SELECT query_id, brand, model, priority, CAST(brand IS NOT NULL AS INT) + CAST(model IS NOT NULL AS INT) AS active
FROM merged WHERE price_min IS NOT NULL OR price_max IS NOT NULL OR year_min IS NOT NULL
  OR year_max IS NOT NULL OR gearbox IS NOT NULL OR sources IS NOT NULL OR multi_only OR unflagged""")
def relaxed_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    loose = I.relax(merged_queries(spark, sf_dir))
    return loose.select("query_id", "brand", "model", "priority", I.active_filters().alias("active"))


def _market_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents in the terms of the parts market; three in four customers have a ceiling of their own."""
    k = F.col("c_custkey")
    null = lambda kind: F.lit(None).cast(kind)
    return B.table(spark, sf_dir, "customer").select(
        k.alias("query_id"),
        F.when(k % 3 > 0, F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string"))).alias("brand"),
        F.when(k % 3 == 2, F.element_at(F.array(F.lit("PROMO"), F.lit("SMALL"), F.lit("LARGE")), (k % 4 % 3 + 1).cast("int"))).alias("model"),
        null("string").alias("gearbox"), F.when(k % 5 == 0, 1997).alias("year_min"), F.when(k % 5 == 1, 2000).alias("year_max"),
        F.when(k % 7 == 0, 1_000_000 + k * 11 % 700_000).cast("bigint").alias("price_min"), F.when(k % 4 != 1, 700_000 + k * 37 % 5_000_000).cast("bigint").alias("price_max"),
        F.when(k % 6 == 0, F.array(F.lit("s1"), F.lit("s3"))).alias("sources"), (k % 2 == 0).alias("multi_only"), (k % 9 == 0).alias("unflagged"),
        F.element_at(F.array(F.lit("relevant"), F.lit("cheapest"), F.lit("lowkm"), F.lit("value")), (k % 4 + 1).cast("int")).alias("priority"),
    )


_PAIRS = """SELECT query_id, c.*, w.*, min(median_price) OVER (PARTITION BY query_id) AS lo, max(median_price) OVER (PARTITION BY query_id) AS hi, count(*) OVER (PARTITION BY query_id) AS total
  FROM i JOIN cards c ON (i.qb IS NULL OR i.qb = c.brand) AND (i.qm IS NULL OR i.qm = c.model) AND (query_id % 5 <> 0 OR c.year >= 1997) AND (query_id % 5 <> 1 OR c.year <= 2000)
    AND (query_id % 7 <> 0 OR c.max_price >= 1000000 + query_id * 11 % 700000) AND (query_id % 4 = 1 OR c.min_price <= 700000 + query_id * 37 % 5000000) AND (query_id % 6 <> 0 OR contains(sources, 's1') OR contains(sources, 's3'))
    AND (query_id % 2 <> 0 OR c.source_count > 1) AND (query_id % 9 <> 0 OR c.clean_count > 0) JOIN weights w ON w.mode = i.m"""


@query("search_many", f"""WITH {CARDS}, {WEIGHTS}, i AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 3 > 0 THEN 'Brand#' || (c_custkey % 25 + 1) END AS qb,
  CASE WHEN c_custkey % 3 = 2 THEN ['PROMO', 'SMALL', 'LARGE'][c_custkey % 4 % 3 + 1] END AS qm, ['relevant', 'cheapest', 'lowkm', 'value'][c_custkey % 4 + 1] AS m FROM customer),
s AS ({score_sql(_PAIRS)}) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, spec_key) AS rank, spec_key, score, total FROM s QUALIFY rank <= 24""")
def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranking.rank_many(card_store(spark, sf_dir), _market_intents(spark, sf_dir), scale=SCALE)
    return best.select("query_id", "rank", "spec_key", "score", "total")


@query("intent_validate", """WITH e AS (SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 6 = 0 THEN 'ghost' ELSE 'Brand#' || (o_orderkey % 26) END AS b, CASE WHEN o_orderkey % 5 = 0 THEN 'x/PROMO' WHEN o_orderkey % 5 = 1 THEN 'nothing' ELSE 'SMALL' END AS m,
    year(o_orderdate) AS y1, 1350 + o_orderkey % 100 AS y2, CAST(o_totalprice * 100 AS BIGINT) AS p1, CAST(o_totalprice * 1000 AS BIGINT) % 90000000 AS p2 FROM orders),
c AS (SELECT *, CASE WHEN y1 - 621 BETWEEN 1300 AND 1406 THEN y1 - 621 END AS a1, CASE WHEN y2 BETWEEN 1300 AND 1406 THEN y2 END AS a2,
  CASE WHEN p1 BETWEEN 10000000 AND 500000000000 THEN p1 END AS q1, CASE WHEN p2 BETWEEN 10000000 AND 500000000000 THEN p2 END AS q2 FROM e)
SELECT query_id, k.p_brand AS brand, mm.p_type AS model, CASE WHEN a1 > a2 THEN a2 ELSE a1 END AS year_min, CASE WHEN a1 > a2 THEN a1 ELSE a2 END AS year_max,
  CASE WHEN q1 > q2 THEN q2 ELSE q1 END AS price_min, CASE WHEN q1 > q2 THEN q1 ELSE q2 END AS price_max
FROM c LEFT JOIN (SELECT DISTINCT p_brand FROM part) k ON k.p_brand = b LEFT JOIN (SELECT DISTINCT p_brand, p_type FROM part) mm ON mm.p_brand = k.p_brand AND mm.p_type = split_part(m, '/', CASE WHEN contains(m, '/') THEN 2 ELSE 1 END)""")
def intent_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    external = B.table(spark, sf_dir, "orders").select(
        k.alias("query_id"), F.when(k % 6 == 0, "ghost").otherwise(F.concat(F.lit("Brand#"), (k % 26).cast("string"))).alias("brand"),
        F.when(k % 5 == 0, "x/PROMO").when(k % 5 == 1, "nothing").otherwise("SMALL").alias("model"),
        F.year("o_orderdate").alias("year_min"), (k % 100 + 1350).alias("year_max"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("price_min"), (F.round(F.col("o_totalprice") * 1000).cast("bigint") % 90_000_000).alias("price_max"),
    )
    part = B.table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("model"))
    rows = I.validate(external, part, part)
    return rows.select("query_id", "brand", "model", "year_min", "year_max", "price_min", "price_max")


GRADED = ("brand", "price_max", "year_min")


_CASES = f"""{PARSED}, c AS (SELECT *, CASE WHEN query_id % 10 IN (0, 2, 3, 6, 9) THEN 'alpha' WHEN query_id % 10 IN (1, 4, 5) THEN 'beta' END AS wb,
  CASE WHEN query_id % 10 IN (0, 7) THEN n * 1000000 END AS wp, CASE WHEN query_id % 10 = 2 THEN CASE WHEN y >= 2000 THEN 1400 + y % 100 ELSE 1300 + y % 100 END WHEN query_id % 10 IN (3, 5) THEN y - 621 END AS wy,
  CASE WHEN query_id % 97 = 0 THEN 'timeout' END AS err FROM parsed)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("query_id") % 10
    century = F.when(F.col("y") >= 2000, 1400).otherwise(1300) + F.col("y") % 100
    return parsed_queries(spark, sf_dir).select(
        F.col("query_id").alias("case_id"), "latency", *[F.col(f).cast("string").alias(f"got_{f}") for f in GRADED],
        F.when(at.isin(0, 2, 3, 6, 9), "alpha").when(at.isin(1, 4, 5), "beta").alias("want_brand"),
        F.when(at.isin(0, 7), F.col("n") * 1_000_000).cast("string").alias("want_price_max"),
        F.when(at == 2, century).when(at.isin(3, 5), F.col("y") - 621).cast("string").alias("want_year_min"),
        F.when(F.col("query_id") % 97 == 0, "timeout").alias("error"), F.when(F.col("confidence") > 0.3, "rules").when(at == 8, "model").alias("source"),
    )


@query("eval_report", f"""WITH {_CASES},
g AS (SELECT *, coalesce(brand, '') = wb AS ob, coalesce(price_max, 0) = wp AS op, coalesce(year_min, 0) = wy AS oy FROM c),
r AS (SELECT 'case' AS metric, count(*) AS n, count(*) FILTER (coalesce(ob, true) AND coalesce(op, true) AND coalesce(oy, true)) AS correct FROM g
  UNION ALL SELECT 'brand', count(wb), count(*) FILTER (ob) FROM g UNION ALL SELECT 'price_max', count(wp), count(*) FILTER (op) FROM g UNION ALL SELECT 'year_min', count(wy), count(*) FILTER (oy) FROM g)
SELECT metric, n, correct, ((2000 * correct + n) // (2 * n)) / 10.0 AS pct FROM r
UNION ALL SELECT 'latency_p50', count(*), NULL, median(latency) FROM g
UNION ALL SELECT 'latency_p95', count(*), NULL, list_sort(list(latency))[least(count(*) - 1, count(*) * 95 // 100) + 1]::DOUBLE FROM g""")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(_cases(spark, sf_dir), GRADED, "latency")


@query("eval_failures", f"""WITH {_CASES}, f AS (SELECT query_id AS case_id, err, unnest([
  CASE WHEN err IS NULL AND coalesce(brand, '') <> wb THEN {{'field': 'brand', 'wanted': wb, 'got': coalesce(brand, '')}} END,
  CASE WHEN err IS NULL AND coalesce(price_max, 0) <> wp THEN {{'field': 'price_max', 'wanted': CAST(wp AS VARCHAR), 'got': coalesce(CAST(price_max AS VARCHAR), '')}} END,
  CASE WHEN err IS NULL AND coalesce(year_min, 0) <> wy THEN {{'field': 'year_min', 'wanted': CAST(wy AS VARCHAR), 'got': coalesce(CAST(year_min AS VARCHAR), '')}} END,
  CASE WHEN err IS NOT NULL THEN {{'field': 'error', 'wanted': '', 'got': err}} END]) AS w FROM c)
SELECT case_id, w.field AS field, w.wanted AS wanted, w.got AS got FROM f WHERE w IS NOT NULL""")
def eval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation_failures(_cases(spark, sf_dir), GRADED, "case_id", "error")


@query("eval_sources", f"""WITH {_CASES} SELECT CASE WHEN err IS NOT NULL THEN 'error' WHEN brand IS NOT NULL THEN 'rules' WHEN query_id % 10 = 8 THEN 'model' ELSE '?' END AS source, count(*) AS n FROM c GROUP BY 1""")
def eval_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation_counts(_cases(spark, sf_dir), "source", "error")


@query("quality_label_report", """SELECT lang, source, count(*) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic,
  count(*) FILTER ((n_chars >= 500) = (quality = 1)) AS agrees FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2""")
def quality_label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = B.table(spark, sf_dir, "labels").join(B.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    return joined.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"),
        F.count_if((F.col("n_chars") >= 500) == (F.col("quality") == 1)).alias("agrees"),
    )


@query("crawl_work_list", """WITH b AS (SELECT NULL AS brand UNION ALL SELECT unnest(['pride', 'peugeot', 'samand']))
SELECT lower(n_name) AS city, brand, 'https://list.example/' || lower(n_name) || '/car' || coalesce('/' || brand, '') AS url FROM nation, b""")
def crawl_work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = B.table(spark, sf_dir, "nation").select(F.lower("n_name").alias("city"))
    return S.work_list(cities, ["pride", "peugeot", "samand"], "https://list.example/{city}/car", "https://list.example/{city}/car/{brand}")


@query("ip_prefixes", r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}(?:\.[0-9]{1,3}){3}')) AS ip FROM documents)
SELECT doc_id, ip, CASE WHEN list_max([CAST(x AS INT) FOR x IN string_split(ip, '.')]) <= 255 AND NOT regexp_matches(ip, '(^|\.)0[0-9]')
  THEN regexp_extract(ip, '^([0-9]+\.[0-9]+\.[0-9]+)\.', 1) || '.0/24' ELSE '' END AS prefix FROM t""")
def ip_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.explode(F.regexp_extract_all("text", F.lit(r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})"), 1))
    rows = B.table(spark, sf_dir, "documents").select("doc_id", found.alias("ip"))
    return rows.select("doc_id", "ip", ip_prefix(F.col("ip")).alias("prefix"))
