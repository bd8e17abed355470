"""Rules on single records, with invented listings."""

import json

import pytest
from pyspark.sql import functions as F

from offerlens.functions import labels as L
from offerlens.functions import text as T
from offerlens.functions.urls import listing_identity
from offerlens.functions.vocabulary import DICTIONARY_SCHEMA, TRIM_ALIASES, Alias, Vocabulary
from offerlens.operators.conform import conform
from offerlens.operators.flags import FlagRules, record_flags
from offerlens.operators.resolve import entity_key, resolve, route, valid_key
from offerlens.plans.index import build_index, labelled, search

ROWS = [
    ("brand", "", "peugeot", "پژو", "peugeot"), ("brand", "", "peugeot", "پژو", "پژو"), ("brand", "", "toyota", "تویوتا", "toyota"),
    ("brand", "", "dena", "دنا", "دنا"), ("model", "peugeot", "206-sd", "۲۰۶ SD", "206 sd"), ("model", "peugeot", "206", "۲۰۶", "206"),
    ("model", "peugeot", "206", "۲۰۶", "۲۰۶"), ("model", "toyota", "corolla-cross", "کرولا کراس", "corolla cross"),
    ("model", "toyota", "corolla", "کرولا", "corolla"), ("model", "dena", "plus", "دنا پلاس", "دنا پلاس"), ("model", "dena", "base", "دنا", "دنا"),
    *[("trim", "", slug, None, a) for slug, aliases in TRIM_ALIASES for a in aliases],
]


def literal():
    """The rows as a vocabulary written out in a program: aliases folded, equal ones once."""
    folded = {"brand": [], "model": [], "trim": []}
    labels = {}
    for i, (kind, brand, slug, label, alias) in enumerate(ROWS):
        plain = " ".join(alias.translate(str.maketrans("۰۱۲۳۴۵۶۷۸۹", "0123456789")).replace("‌", " ").lower().split())
        folded[kind].append(Alias(slug, plain, i, brand))
        labels.setdefault((brand, slug), label)
    return Vocabulary(*(tuple(folded[k]) for k in ("brand", "model", "trim")), {k: v for k, v in labels.items() if v})


@pytest.fixture(scope="module", params=["literal", "table"])
def vocab(spark, request):
    if request.param == "literal":
        return literal()
    return spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], DICTIONARY_SCHEMA)


def one(spark, *columns, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    row = spark.createDataFrame([tuple(values.values())], schema).select(*columns).first()
    return tuple(row) if len(columns) > 1 else row[0]


def test_fold(spark):
    c = F.col("t")
    assert one(spark, T.fold_text(c), t="  پژو، ۲۰۶‌تیپ ٥ / كيا ") == "پژو 206 تیپ 5 کیا"
    assert one(spark, T.fold_text(c, True), t="ＡＢ۱ ﭘﮋﻭ") == "ab1 پژو"


def test_lenient_numbers(spark):
    c = F.col("t")
    assert one(spark, T.lenient_int(c), t="۱۲.۵ km") == 125
    assert one(spark, T.lenient_int(c), t="---") is None
    assert one(spark, T.mileage(c), t="صفر کیلومتر") == 0
    assert one(spark, T.canonical_price(F.col("n"), F.lit(10)), n=3_100_000_009) == 310_000_000
    assert one(spark, T.canonical_price(F.col("n"), F.lit(10)), n=10_000) is None
    assert one(spark, *T.split_year(F.col("n")), n=2017) == (1396, 2017)
    assert one(spark, *T.split_year(F.col("n")), n=1398) == (1398, 2019)
    assert one(spark, *T.split_year(F.col("n")), n=98) == (None, None)


def test_keyword_longest_wins(spark):
    from offerlens.operators.conform import BODY_STATUS

    assert one(spark, T.keyword_label(F.col("t"), BODY_STATUS), t="گلگیر تعویض") == "تعویض"
    assert one(spark, T.keyword_label(F.col("t"), BODY_STATUS), t="تمام رنگ دارد") == "تمام‌رنگ"
    assert one(spark, T.keyword_label(F.col("t"), BODY_STATUS), t="  ") is None


def test_phone_is_cut_and_price_stays(spark):
    got = one(spark, T.clean_prose(F.col("t")), t="تماس ۰۹۱۲ ۱۲۳ ۴۵۶۷\n\n\n\nقیمت ۲,۱۰۰,۰۰۰,۰۰۰   تومان")
    assert got == f"تماس {T.PHONE_TAG}\n\nقیمت ۲,۱۰۰,۰۰۰,۰۰۰ تومان"
    assert one(spark, T.clean_prose(F.col("t")), t=" . ") is None


def test_labels(spark):
    urls = F.array(*[F.lit(u) for u in ("https://a/x/1.jpg", "https://a/y/1.webp?z", "rel/2.jpg", "https://a/3.png")])
    assert one(spark, L.clean_images(urls), t="x") == ["https://a/x/1.jpg", "https://a/3.png"]
    assert one(spark, L.condition_label(F.col("t")), t="https://schema.org/UsedCondition") == "کارکرده"
    assert one(spark, L.body_label(F.col("t")), t="Limousine") == "Limousine"
    assert one(spark, L.compact_money(F.col("n")), n=1_250_000_000) == "1.3 میلیارد"
    assert one(spark, L.spoken_budget(F.col("n")), n=1250) == "1250 میلیون"
    assert one(spark, T.clamp_label(F.col("t")), t="a‮b") == "landing"
    assert one(spark, T.clamp_label(F.col("t")), t=" صفحه‌ی اصلی ") == "صفحه‌ی اصلی"
    assert one(spark, T.defuse_formula(F.col("t")), t="=1+1") == "'=1+1"
    assert one(spark, T.ip_prefix(F.col("t")), t="10.2.3.4") == "10.2.3.0/24"


@pytest.mark.parametrize("url, want", [
    ("https://divar.ir/v/some-title/AbC", ("divar", "AbC")), ("https://divar.ir/v/some-title", None),
    ("www.bama.ir/car/detail-x1y-peugeot-206?ref=1", ("bama", "x1y")), ("https://bama.ir/car/peugeot", None),
    ("https://www.hamrah-mechanic.com/cars-for-sale/a/b/123/", ("hamrah", "123")), ("https://hamrah-mechanic.com/a/b", None),
    ("khodro45.com/used-car/slug-1/", ("khodro45", "slug-1")), ("https://www.sheypoor.com/v/a-b-42.html", ("sheypoor", "42")),
    ("https://sheypoor.com/v/a-b.html", None), ("https://other.example/v/a/b", None), ("", None), ("HTTPS://DIVAR.IR:443/v/a/b#x", ("divar", "b")),
])
def test_listing_identity(spark, url, want):
    got = one(spark, listing_identity(F.col("u")), u=url)
    assert (tuple(got) if got else None) == want


CASES = [
    (dict(km=1_000_000, year=1385), ["mileage_sentinel"]), (dict(km=1_000_000), ["mileage_sentinel", "mileage_vs_age"]), (dict(km=0, year=1385), ["zero_km_old_car"]),
    (dict(km=0, body="تعویض"), ["zero_km_with_bodywork"]), (dict(km=400_000, year=1402), ["mileage_vs_age"]), (dict(title="حواله دنا"), ["not_a_car_yet"]),
    (dict(title="ثبت‌نام تارا"), ["not_a_car_yet"]), (dict(title="فروش اقساطی"), ["instalment_price"]), (dict(title="فروش سازمانی"), ["off_market_sale"]),
    (dict(title="خودروی سازمانی بوده"), []), (dict(price=None), ["no_price"]), (dict(km=0, year=1405), []), (dict(km=None, year=None), []),
]


@pytest.mark.parametrize("change, codes", CASES)
def test_flags(spark, change, codes):
    car = {"km": 50_000, "year": 1404, "body": "بدون رنگ", "title": "پژو", "price": 900_000_000, **change}
    df = spark.createDataFrame([tuple(car.values())], "km bigint, year int, body string, title string, price bigint")
    flags = df.select(record_flags(FlagRules(), *[F.col(c) for c in ("km", "year", "body", "title", "price")]).alias("f")).first().f
    assert [f.code for f in flags] == codes


def test_three_spellings_one_key(spark, vocab):
    rows = [("Peugeot", "Peugeot 206 5", None, "پژو ۲۰۶ تیپ ۵"), ("پژو", "206", "تیپ ۵", "پژو، 206"), ("peugeot", "206", "type 5", None),
            ("پژو", None, None, "پژو 206 SD"), ("toyota", "Corolla Cross", None, None), ("پژو", None, None, "پژو 2061"), (None, None, None, "سلام"), (None,) * 4]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b string, m string, t string, title string")
    r = [x.resolution for x in resolve(df, vocab, ["b", "m", "t", "title"]).orderBy("i").collect()]
    assert {(x.brand, x.model, x.trim) for x in r[:3]} == {("peugeot", "206", "type-5")}
    assert [x.model for x in r[3:]] == ["206-sd", "corolla-cross", None, None, None]
    assert [x.confidence for x in r] == [0.95, 0.95, 0.95, 0.85, 0.85, 0.45, 0.0, 0.0]
    sure, unsure = route(resolve(df, vocab, ["b", "m", "t", "title"]))
    assert (sure.count(), unsure.count()) == (5, 3)


def test_key(spark):
    key = entity_key(F.lit("peugeot"), F.lit("206"), F.lit("type-5"), F.lit("اتوماتیک"), F.lit(1396), F.lit(112_000))
    assert one(spark, key, t="x") == "peugeot/206/type-5/at/1396/4"
    bare = entity_key(F.lit("peugeot"), F.lit("206"), F.lit(None), F.lit(None), F.lit(1396), F.lit(None).cast("bigint"))
    assert one(spark, bare, t="x") == "peugeot/206/base/na/1396/na"
    assert one(spark, entity_key(F.lit("a"), F.lit(None), F.lit(None), F.lit(None), F.lit(1396), F.lit(1)), t="x") is None
    assert one(spark, valid_key(F.col("t")), t="peugeot/206/type-5/at/1396/4") is True
    assert one(spark, valid_key(F.col("t")), t="peugeot/206") is False


def capture(source, sid, at, **payload):
    return (source, sid, None, "list", f"h{at}{sid}", f"2026-01-{at:02d}T00:00:00Z", json.dumps(payload, ensure_ascii=False))


def divar(sid, at, price, km=60_000, name="پژو ۲۰۶ تیپ ۵"):
    return capture("divar", sid, at, name=name, brand={"name": "Peugeot"}, productionDate="1396", mileageFromOdometer={"value": km},
                   offers={"price": price * 10}, vehicleTransmission="automatic", url=f"https://divar.ir/v/x/{sid}", image="https://i/a.jpg")


def bama(sid, at, price, kind="lumpsum"):
    return capture("bama", sid, at, detail={"title": "پژو، 206", "brand_fa": "پژو", "brand": "206", "trim": "تیپ ۵", "year": "۱۳۹۶", "mileage": "۶۱٬۰۰۰",
                   "transmission": "اتوماتیک", "location": "تهران / ونک", "code": sid}, price={"price": f"{price:,}", "type": kind})


@pytest.fixture(scope="module")
def index(spark, vocab):
    rows = [
        divar("a", 1, 900_000_000), divar("a", 3, 500_000_000), divar("b", 2, 520_000_000), bama("c", 2, 510_000_000), bama("d", 2, 530_000_000),
        divar("e", 2, 90_000_000), bama("f", 2, 505_000_000, "installment"), divar("g", 2, 515_000_000, name="حواله پژو ۲۰۶ تیپ ۵"),
        capture("bama", "h", 1, detail={"title": "ناشناس", "year": 1400, "code": "h"}, price={"price": 700_000_000}),
    ]
    captures = spark.createDataFrame(rows, "source string, source_id string, city string, list_url string, content_hash string, fetched_at string, payload string")
    return build_index(captures, vocab)


def test_whole_build(index):
    card = index.cards.collect()
    assert len(card) == 1
    c = card[0]
    assert c.spec_key == "peugeot/206/type-5/at/1396/2"
    assert (c.offer_count, c.source_count, c.median_price, c.median_reliable) == (6, 2, 512_500_000, True)
    assert (c.min_price, c.max_price, c.flag_count, c.clean_count) == (500_000_000, 530_000_000, 2, 4)
    assert (c.brand_fa, c.model_fa, c.trim, c.gearbox_fa, c.image) == ("پژو", "۲۰۶", "type-5", "اتوماتیک", "https://i/a.jpg")
    offers = {r.source_id: r for r in index.offers.collect()}
    assert [f.code for f in offers["e"].flags] == ["price_outlier"]
    assert offers["a"].vs_median_pct == -2.4
    stats = index.stats.first()
    assert (stats.listings_captured, stats.listings, stats.indexed, stats.unresolved, stats.duplicates_collapsed) == (9, 8, 6, 2, 1)
    assert (stats.specs, stats.multi_source_specs, stats.flagged_offers, stats.sources) == (1, 1, 1, "bama,divar")


def test_search_finds_the_card(spark, index, vocab):
    queries = spark.createDataFrame([(1, "پژو ۲۰۶ زیر ۶۰۰"), (2, "toyota"), (3, "206 اتوماتیک مدل ۹۶"), (4, "206 زیر ۳۰۰ میلیون")], "query_id int, q string")
    overrides = spark.createDataFrame([(4, None, None, None, None, "", None, None, None, None, None)],
                                      "query_id int, brand string, model string, gearbox string, price_min string, price_max string, year_min string, year_max string, sources string, multi_only string, unflagged string")
    assert sorted(r.query_id for r in search(index.cards, queries, vocab).collect()) == [1, 3]
    got = search(index.cards, queries, vocab, overrides).collect()
    assert sorted(r.query_id for r in got) == [1, 3, 4]
    assert all(abs(sum(r.breakdown.values()) - r.score) < 1e-6 for r in got)


def test_names_are_said_once(spark, vocab):
    df = spark.createDataFrame([("dena", "plus", "plus", "mt"), ("dena", "base", "base", "na")], "brand string, model string, trim string, gearbox string")
    got = [(r.model_fa, r.trim) for r in labelled(df, vocab).collect()]
    assert got == [("پلاس", None), ("", None)]


def test_conform_edge_cases(spark):
    rows = [
        capture("bama", "1", 1, detail={"title": "t", "brand": "x", "mileage": "صفر", "location": " "}, price={"price": 5}),
        capture("khodro45", "2", 1, car_properties={"brand": {"title": "ب"}, "model": {}, "trim": "اتوماتیک توربو"}, car_specifications={"klm": 12.9, "is_klm_matched": False}),
        capture("sheypoor", "3", 1, offers={"Price": "41,000,000,000"}, image=[{"contentUrl": "u"}], vehicleModelDate=2019),
        ("divar", "4", None, "l", "h", "2026-01-01T00:00:00Z", "{broken"),
    ]
    df = spark.createDataFrame(rows, "source string, source_id string, city string, list_url string, content_hash string, fetched_at string, payload string")
    got = {r.source_id: r for r in conform(df).collect()}
    assert (got["1"].mileage_km, got["1"].price_toman, got["1"].city, got["1"].brand_raw) == (0, None, None, "x")
    assert (got["2"].title, got["2"].mileage_km, got["2"].transmission, got["2"].km_verified) == ("ب", 12, "اتوماتیک", False)
    assert got["2"].url == "https://khodro45.com/used-car/"
    assert (got["3"].price_toman, got["3"].image, got["3"].year_jalali) == (4_100_000_000, "u", 1398)
    assert got["4"].title is None
