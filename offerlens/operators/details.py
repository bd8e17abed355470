"""Detail pages of five sources to one struct, and the limits of what is served."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.labels import body_label, clean_images, condition_label
from offerlens.functions.text import ASCII_DIGITS, FOREIGN_DIGITS, clean_prose, once, strip_prefix
from offerlens.operators.conform import BODY_STATUS
from offerlens.sources.captures import at, data_blocks, has_type, items, page_state, text_at

# Platform sentences, spec keys, document words, forbidden extras.
BAMA_SENTENCE = r"^خرید خودرو .{0,120}? در شهر [^،]{1,30}،\s*"
HAMRAH_SENTENCE = r"^این خودرو توسط همراه مکانیک کارشناسی شده است[^.]*\.\s*"
HAMRAH_SPECS = {"color": "color", "fuelType": "fuel", "bodyType": "body", "bodyCondition": "damages"}
HAMRAH_EXTRAS = {"technicalDescription": "وضعیت فنی", "document": "سند", "remainingInsurance": "مانده بیمه"}
DOCUMENT_WORDS = {"6_dong": "شش‌دانگ", "power_of_attorney": "وکالتی", "free": "آزاد"}
FORBIDDEN_EXTRAS = ("قیمت", "price", "کارکرد", "mileage", "کیلومتر")
DIVAR_PHOTO = r"(https://[a-z0-9.-]*divarcdn\.com/static/photo/[^\s\"'\\<>]+?\.(?:webp|jpe?g|png))"

TEXT_FIELDS = ("description", "color", "damages", "condition", "fuel", "body", "engine")
DETAIL_FIELDS = (*TEXT_FIELDS, "images", "inspection", "extras")

MAX_DESCRIPTION, MAX_FIELD, MAX_IMAGES, MAX_IMAGE_BYTES, MAX_EXTRAS, MAX_INSPECTION = 4000, 200, 8, 512, 20, 16 << 10

def _strip(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _shown_number(v: Column, path: str) -> Column:
    """A JSON number in the other digit system, without a trailing ".0"."""
    n = F.try_variant_get(v, path, "double")
    is_number = ~F.schema_of_variant(at(v, path)).isin("STRING", "BOOLEAN", "VOID")
    text = F.regexp_replace(n.cast("decimal(18,6)").cast("string"), r"\.?0+$", "")
    text = F.when(n == F.floor(n), n.cast("bigint").cast("string")).otherwise(text)
    return F.when(is_number, F.translate(text, ASCII_DIGITS[:10], FOREIGN_DIGITS[:10]))


def _extras(entries: Mapping[str, Column]) -> Column:
    """Non-empty leftovers, without any that would republish a price or a reading."""
    built = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries.items()]))
    return _allowed(built)


def _allowed(m: Column) -> Column:
    def fine(k: Column, v: Column) -> Column:
        bad = F.lit(False)
        for word in FORBIDDEN_EXTRAS:
            bad = bad | F.lower(k).contains(word)
        return v.isNotNull() & (F.length(F.trim(v)) > 0) & ~bad

    return F.map_filter(m, fine)


def _first(blocks: Column, test) -> Column:
    return F.get(F.filter(blocks, test), F.lit(0))


def inspection(report: Column) -> Column:
    """Section scores and the parts that are not perfect or carry a note, as JSON."""
    note_texts = lambda p: F.array_compact(
        F.transform(items(at(p, "$.condition.conditionDescription")), lambda d: F.nullif(F.trim(F.try_variant_get(d, "$.text", "string")), F.lit("")))
    )
    perfect = lambda p: F.coalesce(F.try_variant_get(p, "$.isPerfect", "boolean"), F.lit(False))
    section = lambda c: F.struct(
        *[F.try_variant_get(c, f"$.{path}", kind).alias(name) for name, path, kind in (
            ("key", "key", "string"), ("title", "title", "string"), ("score", "score", "double"),
            ("damaged", "numberOfDamagedParts", "int"), ("healthy", "numberOfHealthyParts", "int"))]
    )
    telling = lambda c: F.filter(items(at(c, "$.parts")), lambda p: ~perfect(p) | (F.size(note_texts(p)) > 0))
    parts = lambda c: F.transform(telling(c), lambda p: F.struct(
        F.try_variant_get(c, "$.title", "string").alias("section"), F.try_variant_get(p, "$.title", "string").alias("part"),
        perfect(p).alias("ok"), F.nullif(F.array_join(note_texts(p), " "), F.lit("")).alias("note"),
    ))
    collections = items(at(report, "$.collections"))
    packed = F.struct(
        F.try_variant_get(report, "$.reportTitle", "string").alias("title"),
        F.transform(collections, section).alias("sections"),
        F.flatten(F.transform(collections, parts)).alias("parts"),
        F.filter(F.transform(items(at(report, "$.damagedParts")), lambda p: F.try_variant_get(p, "$", "string")), lambda p: p != "").alias("damaged_parts"),
    )
    return F.when(F.size(collections) > 0, F.to_json(packed))


def _shape(**given: Column) -> Column:
    empty_map = F.create_map().cast("map<string,string>")
    empty_list = F.array().cast("array<string>")
    none = F.lit(None).cast("string")
    get = lambda k: given.get(k, none)
    return F.struct(
        clean_prose(get("description")).alias("description"), _strip(get("color")).alias("color"),
        _strip(get("damages")).alias("damages"), get("condition").cast("string").alias("condition"), _strip(get("fuel")).alias("fuel"),
        get("body").cast("string").alias("body"), get("engine").cast("string").alias("engine"),
        F.coalesce(given.get("images", empty_list), empty_list).alias("images"),
        get("inspection").cast("string").alias("inspection"), F.coalesce(given.get("extras", empty_map), empty_map).alias("extras"),
    )


def _divar(body: Column, blocks: Column, car: Column) -> Column:
    photos = F.array_distinct(F.regexp_extract_all(body, F.lit(DIVAR_PHOTO), 1))
    thumb = lambda u: u.contains("/webp_thumbnail/")
    ordered = F.concat(F.array_compact(F.array(text_at(car, "$.image"))), F.filter(photos, lambda u: ~thumb(u)), F.filter(photos, thumb))
    damages = text_at(car, "$.knownVehicleDamages")
    words = F.create_map(*[F.lit(x) for kv in BODY_STATUS.items() for x in kv])
    out = _shape(
        description=text_at(car, "$.description"), color=text_at(car, "$.color"),
        damages=F.coalesce(F.try_element_at(words, F.lower(damages)), damages),
        condition=condition_label(text_at(car, "$.itemCondition")), images=clean_images(ordered),
    )
    return out


def _bama(body: Column, blocks: Column, car: Column) -> Column:
    nodes = F.flatten(F.transform(blocks, lambda b: F.filter(items(at(b, '$["@graph"]')), lambda n: has_type(n, "ImageObject"))))
    photos = F.array_compact(F.concat(F.array(text_at(car, "$.image")), F.transform(nodes, lambda n: F.try_variant_get(n, "$.contentUrl", "string"))))
    litres = F.when(text_at(car, "$.vehicleEngine.engineDisplacement.unitCode") == "LTR", _shown_number(car, "$.vehicleEngine.engineDisplacement.value"))
    interior = F.trim(text_at(car, "$.vehicleInteriorColor"))
    out = _shape(
        description=strip_prefix(text_at(car, "$.description"), BAMA_SENTENCE), color=text_at(car, "$.color"),
        condition=condition_label(text_at(car, "$.itemCondition")), fuel=text_at(car, "$.fuelType"), body=body_label(text_at(car, "$.bodyType")),
        engine=F.concat(litres, F.lit(" لیتر")), images=clean_images(photos),
        # Names and units of the further fields.
        extras=_extras({
            "رنگ داخلی": F.when(interior != "-", interior),
            "مصرف سوخت": F.concat(_shown_number(car, "$.fuelConsumption.value"), F.lit(" لیتر در ۱۰۰ کیلومتر")),
            "شتاب ۰ تا ۱۰۰": F.concat(_shown_number(car, "$.accelerationTime.value"), F.lit(" ثانیه")),
            "شناسه آگهی": text_at(car, "$.identifier"),
        }),
    )
    return out


def _sheypoor(body: Column, blocks: Column, car: Column) -> Column:
    photos = F.array_compact(F.transform(items(at(car, "$.image")), lambda i: F.try_variant_get(i, "$.contentUrl", "string")))
    single = F.when(F.size(items(at(car, "$.image"))) == 0, F.array_compact(F.array(text_at(car, "$.image"))))
    out = _shape(
        description=text_at(car, "$.description"), color=text_at(car, "$.color"), damages=text_at(car, "$.knownVehicleDamages"),
        condition=condition_label(text_at(car, "$.itemCondition")), fuel=text_at(car, "$.vehicleEngine.fuelType"),
        body=body_label(text_at(car, "$.bodyType")), images=clean_images(F.coalesce(single, photos)),
    )
    return out


def _hamrah(body: Column, blocks: Column, props: Column) -> Column:
    specs = F.filter(items(at(props, "$.orderDetails.carSpecifications.specs")), lambda s: F.length(F.trim(F.try_variant_get(s, "$.value", "string"))) > 0)

    def spec(key: str) -> Column:
        same = F.filter(specs, lambda s: F.try_variant_get(s, "$.key", "string") == key)
        return F.trim(F.try_variant_get(F.get(same, F.size(same) - 1), "$.value", "string"))

    features = F.array_compact(F.transform(items(at(props, "$.orderDetails.carFeature.features")), lambda f: F.nullif(F.trim(F.try_variant_get(f, "$", "string")), F.lit(""))))
    fields = {field: spec(key) for key, field in HAMRAH_SPECS.items()}
    photos = F.array_compact(F.transform(items(at(props, "$.gallery")), lambda g: F.try_variant_get(g, "$.largeImage", "string")))
    car_type = F.regexp_replace(F.trim(text_at(props, "$.orderDetails.carInformation.carTypeName")), r"\s+", " ")
    out = _shape(
        description=strip_prefix(text_at(props, "$.orderDetails.descriptionPart.description"), HAMRAH_SENTENCE),
        color=fields["color"], damages=fields["damages"], fuel=fields["fuel"], body=body_label(fields["body"]),
        images=clean_images(photos), inspection=inspection(at(props, "$.inspectionReport")),
        # Names and units of the further fields.
        extras=_extras({
            **{label: spec(key) for key, label in HAMRAH_EXTRAS.items()},
            "نقاط قوت": F.nullif(F.array_join(features, "، "), F.lit("")), "تیپ": car_type,
        }),
    )
    return out


def _khodro45(body: Column, blocks: Column, data: Column) -> Column:
    photos = F.array_compact(F.transform(items(at(data, "$.car_images")), lambda i: F.try_variant_get(i, "$.image.url", "string")))
    words = F.create_map(*[F.lit(x) for kv in DOCUMENT_WORDS.items() for x in kv])
    out = _shape(
        description=text_at(data, "$.car_specifications.additional_information"),
        body=body_label(text_at(data, "$.car_specifications.body_type")), images=clean_images(photos),
        # Names and units of the further fields.
        extras=_extras({
            "سند": F.try_element_at(words, text_at(data, "$.car_specifications.doc_type")),
            "ظرفیت": F.concat(_shown_number(data, "$.car_specifications.capacity"), F.lit(" نفر")),
            "گارانتی خودرو۴۵": F.when(F.try_variant_get(data, "$.guaranteed", "boolean"), F.lit("دارد")),
        }),
    )
    return out


def _root(body: Column, blocks: Column) -> Column:
    """The object that describes the car, by source; NULL when a page has none."""
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))
    heads = F.transform(blocks, lambda b: F.coalesce(F.when(F.schema_of_variant(b).startswith("ARRAY"), at(b, "$[0]")), b))
    mains = F.filter(F.transform(blocks, lambda b: at(b, "$.mainEntity")), is_object)
    source = F.col("source")
    return (
        F.when(source == "divar", _first(heads, lambda b: has_type(b, "Car")))
        .when(source == "bama", _first(blocks, lambda b: has_type(b, "Car")))
        .when(source == "sheypoor", F.get(mains, F.lit(0)))
        .when(source == "hamrah", at(page_state(body), "$.props.pageProps"))
        .when(source == "khodro45", F.try_parse_json(body))
    )


READERS = {"divar": _divar, "bama": _bama, "sheypoor": _sheypoor, "hamrah": _hamrah, "khodro45": _khodro45}


def extract_details(pages: DataFrame, keep: tuple[str, ...] = ("source", "source_id", "fetched_at"), sources: tuple[str, ...] = tuple(READERS)) -> DataFrame:
    """Stored detail pages (``source, source_id, fetched_at, body``) to detail rows.

    A page that yields nothing gives no row. JSON is parsed once per page.
    """
    df = pages.where(F.col("source").isin(*sources)).withColumn("_blocks", data_blocks(F.col("body")))
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))
    df = df.withColumn("_root", F.explode(F.filter(F.array(_root(F.col("body"), F.col("_blocks"))), is_object)))
    detail = None
    for name in sources:
        value = READERS[name](F.col("body"), F.col("_blocks"), F.col("_root"))
        hit = F.col("source") == name
        detail = F.when(hit, value) if detail is None else detail.when(hit, value)
    rows = once(df, "_d", detail).select(*keep, "_d.*")
    return rows.where(has_content())


def has_content() -> Column:
    some = (F.size("images") > 0) | (F.size(F.map_keys("extras")) > 0) | F.col("inspection").isNotNull()
    for name in TEXT_FIELDS:
        some = some | F.col(name).isNotNull()
    return some


def with_tombstones(attempts: DataFrame, details: DataFrame) -> DataFrame:
    """Every attempted listing once; a row without content means tried, got nothing."""
    found = details.drop("fetched_at")
    return attempts.select("source", "source_id", "fetched_at").join(found, ["source", "source_id"], "left")


def capped(details: DataFrame) -> DataFrame:
    """Served form: text cut by characters, bounded lists, oversized reports dropped."""
    texts = {n: F.left(F.col(n), F.lit(MAX_DESCRIPTION if n == "description" else MAX_FIELD)) for n in TEXT_FIELDS}
    images = F.filter(F.slice("images", 1, MAX_IMAGES), lambda u: F.octet_length(u) <= MAX_IMAGE_BYTES)
    entries = F.slice(F.array_sort(F.map_entries("extras")), 1, MAX_EXTRAS)
    cut = F.transform(entries, lambda e: F.struct(F.left(e["key"], F.lit(MAX_FIELD)).alias("key"), F.left(e["value"], F.lit(MAX_FIELD)).alias("value")))
    last_wins = F.filter(
        F.transform(cut, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))),
        lambda e: ~F.exists(F.slice(cut, e["i"] + 2, MAX_EXTRAS), lambda o: o["key"] == e["key"]),
    )
    extras = F.map_from_entries(F.transform(last_wins, lambda e: F.struct(e["key"], e["value"])))
    return details.withColumns(
        {**texts, "images": F.coalesce(images, F.array().cast("array<string>")),
         "extras": F.coalesce(extras, F.create_map().cast("map<string,string>")),
         "inspection": F.when(F.octet_length("inspection") <= MAX_INSPECTION, F.col("inspection"))}
    )
