"""Free-text queries to filters, as column expressions over a queries table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.text import fold_text, once
from offerlens.functions.vocabulary import Vocabulary, longest_match
from offerlens.operators.resolve import dictionary_matches

# The words and number patterns of the query language, over folded text.
NUMBER = r"(\d+(?:\.\d+)?)"
BILLION, MILLION = "میلیارد", "میلیون"
PRICE_RANGE = rf"بین\s*{NUMBER}\s*(?:{BILLION}|{MILLION})?\s*(?:تا|و)\s*{NUMBER}\s*({BILLION}|{MILLION})?"
PRICE_CEILING = rf"(?:زیر|تا|حداکثر|کمتر از)\s*{NUMBER}\s*({BILLION}|{MILLION})?"
PRICE_FLOOR = rf"(?:بالای|بیشتر از|از)\s*{NUMBER}\s*({BILLION}|{MILLION})"
YEAR_RANGE = r"مدل\s*(\d{2,4})\s*(?:تا|الی)\s*(\d{2,4})"
YEAR_FLOOR = r"(?:بالای|از)\s*(?:مدل\s*)?(\d{2,4})"
YEAR_EXACT = r"مدل\s*(\d{2,4})"
YEAR_BARE = r"(?:^|\s)(19\d{2}|20\d{2})(?:\s|$)"
GEARBOX_WORDS = (("اتومات", "at"), ("دنده", "mt"))
PRIORITY_WORDS = (
    (("ارزان", "ارزون"), "cheapest"),
    (("کم کارکرد", "کارکرد کم", "کم کار"), "lowkm"),
    (("بهترین", "مناسب"), "value"),
)
PRICE_SANE = (10_000_000, 500_000_000_000)
YEARS_SANE = (1300, 1406)

INTENT = ("brand", "model", "gearbox", "priority", "price_min", "price_max", "year_min", "year_max", "confidence")
FILTERS = ("brand", "model", "gearbox", "price_min", "price_max", "year_min", "year_max", "sources", "multi_only", "unflagged")


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def year_like(n: Column) -> Column:
    """A bare whole number that is a model year rather than a price."""
    return (n == F.floor(n)) & (n.between(60, 99) | n.between(1300, 1450) | n.between(1990, 2100))


def price_scale(n: Column, unit: Column) -> Column:
    """Shorthand to the full amount: a bare number below 10,000 means millions."""
    factor = F.when(unit == BILLION, 1e9).when(unit == MILLION, 1e6).when(n < 10_000, 1e6).otherwise(1.0)
    return (n * factor).cast("bigint")


def full_year(n: Column) -> Column:
    """Two- and four-digit years of either calendar as a solar Hijri year."""
    return (
        F.when(n.between(1300, 1450), n)
        .when(n.between(60, 99), n + 1300)
        .when(n.between(0, 20), n + 1400)
        .when(n.between(1990, 2100), n - 621)
        .cast("int")
    )


def parse_queries(queries: DataFrame, vocab: Vocabulary | DataFrame, text: str = "q") -> DataFrame:
    """Add the intent columns to a table of queries; NULL means not asked for.

    The dictionary is a :class:`Vocabulary` or a table of any size, with the same rules.
    """
    t = F.col("_t")
    df = once(queries, "_t", fold_text(F.col(text)))
    if isinstance(vocab, DataFrame):
        found = dictionary_matches(df.select("_t"), "_t", vocab, by_bytes=True)
        df = df.join(found.hint("merge"), "_t", "left")
        model = F.when(F.col("_brand").isNotNull(), F.col("_model")).otherwise(F.col("_any.slug"))
        df = df.withColumn("brand", F.coalesce("_brand", "_any.brand")).withColumn("model", model)
    else:
        df = once(df, "_brand", longest_match(t, vocab.brands, by_bytes=True)["slug"])
        within = longest_match(t, vocab.models, F.col("_brand"), by_bytes=True)
        anywhere = longest_match(t, vocab.models, by_bytes=True)
        df = once(df, "_model", F.when(F.col("_brand").isNotNull(), within).otherwise(anywhere))
        df = df.withColumn("brand", F.coalesce("_brand", F.col("_model.brand"))).withColumn("model", F.col("_model.slug"))

    gearbox = F.when(t.contains(GEARBOX_WORDS[0][0]), GEARBOX_WORDS[0][1]).when(t.contains(GEARBOX_WORDS[1][0]), GEARBOX_WORDS[1][1])
    priority = None
    for words, mode in PRIORITY_WORDS:
        hit = t.rlike("|".join(words))
        priority = F.when(hit, mode) if priority is None else priority.when(hit, mode)
    df = df.withColumn("gearbox", gearbox).withColumn("priority", priority.otherwise("relevant"))

    # Each pattern is read once into a column; the rules below use it several times.
    year = lambda pattern, group=1: full_year(F.regexp_extract(t, pattern, group).try_cast("int"))
    df = df.withColumns({
        "_lo": _number(t, PRICE_RANGE, 1), "_hi": _number(t, PRICE_RANGE, 2), "_unit": F.regexp_extract(t, PRICE_RANGE, 3),
        "_ceiling": _number(t, PRICE_CEILING, 1), "_ceiling_unit": F.regexp_extract(t, PRICE_CEILING, 2),
        "_floor": _number(t, PRICE_FLOOR, 1), "_floor_unit": F.regexp_extract(t, PRICE_FLOOR, 2),
        "_first": year(YEAR_RANGE, 1), "_second": year(YEAR_RANGE, 2), "_from": year(YEAR_FLOOR),
        "_exact": year(YEAR_EXACT), "_bare": year(YEAR_BARE),
    })
    lo, hi, ceiling, floor = F.col("_lo"), F.col("_hi"), F.col("_ceiling"), F.col("_floor")
    is_range = F.coalesce((lo > 0) & (hi > 0) & ~year_like(lo), F.lit(False))
    first, second, from_, exact, bare = (F.col(c) for c in ("_first", "_second", "_from", "_exact", "_bare"))
    year_min = F.when(first <= second, first).when(from_.isNotNull(), from_).when(exact.isNotNull(), exact).otherwise(bare)
    year_max = F.when(first <= second, second).when(from_.isNotNull(), F.lit(None)).when(exact.isNotNull(), exact).otherwise(bare)
    df = df.withColumns({
        "price_min": F.when(is_range, price_scale(lo, F.col("_unit"))).when(floor > 0, price_scale(floor, F.col("_floor_unit"))),
        "price_max": F.when(is_range, price_scale(hi, F.col("_unit"))).when(
            (ceiling > 0) & ~year_like(ceiling), price_scale(ceiling, F.col("_ceiling_unit"))
        ),
        "year_min": year_min, "year_max": year_max,
    })
    pinned = F.col("year_min").isNotNull() | F.col("price_max").isNotNull()
    confidence = (
        F.when(F.col("model").isNotNull() & pinned, 0.95)
        .when(F.col("model").isNotNull(), 0.85)
        .when(F.col("brand").isNotNull(), 0.6)
        .otherwise(0.3)
    )
    intent = F.struct(*[F.col(c) for c in INTENT[:-1]], confidence.alias("confidence"))
    return once(df, "_intent", intent).select(*[F.col(c) for c in queries.columns], "_intent.*")


def override(parsed: DataFrame, overrides: DataFrame, on: str = "query_id") -> DataFrame:
    """Explicit parameters over the parse: NULL absent, empty clears, invalid ignored."""
    given = overrides.select(on, *[F.col(f).alias(f"_o_{f}") for f in FILTERS])
    joined = parsed.join(given, on, "left")
    for f in ("brand", "model", "gearbox"):
        o = F.col(f"_o_{f}")
        joined = joined.withColumn(f, F.when(o.isNotNull(), F.nullif(F.trim(o), F.lit(""))).otherwise(F.col(f)))
    for f, kind in (("price_min", "bigint"), ("price_max", "bigint"), ("year_min", "int"), ("year_max", "int")):
        o = F.trim(f"_o_{f}")
        number = F.when(o.rlike(r"^\+?[0-9]+$"), o.try_cast("bigint"))
        merged = F.when(o == "", None).when(number.isNotNull(), F.nullif(number, F.lit(0))).otherwise(F.col(f))
        joined = joined.withColumn(f, merged.cast(kind))
    chosen = F.filter(F.transform(F.split("_o_sources", ","), lambda s: F.trim(s)), lambda s: s != "")
    joined = joined.withColumn("sources", F.when(F.size(chosen) > 0, chosen))
    for f in ("multi_only", "unflagged"):
        joined = joined.withColumn(f, F.coalesce(F.col(f"_o_{f}") == "1", F.lit(False)))
    return joined.drop(*[f"_o_{f}" for f in FILTERS])


def without_overrides(parsed: DataFrame) -> DataFrame:
    """The columns only explicit parameters can set, at their neutral values."""
    return parsed.withColumns(
        {"sources": F.lit(None).cast("array<string>"), "multi_only": F.lit(False), "unflagged": F.lit(False)}
    )


def relax(intents: DataFrame) -> DataFrame:
    """Drop price, year, gearbox and source limits; keep brand and model.

    Only rows that the step changes are returned.
    """
    loose = (
        F.col("price_min").isNotNull() | F.col("price_max").isNotNull() | F.col("year_min").isNotNull()
        | F.col("year_max").isNotNull() | F.col("gearbox").isNotNull() | F.col("sources").isNotNull()
        | F.col("multi_only") | F.col("unflagged")
    )
    kinds = {"price_min": "bigint", "price_max": "bigint", "year_min": "int", "year_max": "int", "gearbox": "string", "sources": "array<string>"}
    cleared = {c: F.lit(None).cast(kind) for c, kind in kinds.items()}
    return intents.where(loose).withColumns({**cleared, "multi_only": F.lit(False), "unflagged": F.lit(False)})


def active_filters() -> Column:
    """How many distinct things narrow the list; a price or year pair counts once."""
    parts = [
        F.col("brand").isNotNull(), F.col("model").isNotNull(), F.col("gearbox").isNotNull(),
        F.col("price_min").isNotNull() | F.col("price_max").isNotNull(),
        F.col("year_min").isNotNull() | F.col("year_max").isNotNull(),
        F.col("sources").isNotNull(), F.col("multi_only"), F.col("unflagged"),
    ]
    return sum((p.cast("int") for p in parts[1:]), parts[0].cast("int"))


def validate(external: DataFrame, brands: DataFrame, models: DataFrame) -> DataFrame:
    """Clamp a parse made elsewhere and drop what the vocabulary does not hold."""

    def sane_year(c: str) -> Column:
        y = F.when(F.col(c).between(1900, 2100), F.col(c) - 621).otherwise(F.col(c))
        return F.when(y.between(*YEARS_SANE), y)

    def sane_price(c: str) -> Column:
        return F.when(F.col(c).between(*PRICE_SANE), F.col(c))

    df = external
    for lo, hi, fix in (("year_min", "year_max", sane_year), ("price_min", "price_max", sane_price)):
        df = df.withColumn("_lo", fix(lo)).withColumn("_hi", fix(hi))
        both = F.col("_lo") > F.col("_hi")
        df = df.withColumn(lo, F.when(both, F.col("_hi")).otherwise(F.col("_lo")))
        df = df.withColumn(hi, F.when(both, F.col("_lo")).otherwise(F.col("_hi"))).drop("_lo", "_hi")
    known_brand = brands.select(F.col("brand").alias("_kb")).distinct()
    known_model = models.select(F.col("brand").alias("_mb"), F.col("model").alias("_mm")).distinct()
    slug = F.element_at(F.split("model", "/"), -1)
    df = df.join(known_brand, F.col("brand") == F.col("_kb"), "left")
    df = df.withColumn("brand", F.col("_kb")).withColumn("model", F.when(F.col("_kb").isNotNull(), slug))
    df = df.join(known_model, (F.col("brand") == F.col("_mb")) & (F.col("model") == F.col("_mm")), "left")
    return df.withColumn("model", F.col("_mm")).drop("_kb", "_mb", "_mm")
