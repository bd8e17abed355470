"""Checks of generated text against the facts it was given."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.text import FOREIGN_DIGITS, ASCII_DIGITS, HALF_SPACE, fold_digits
from offerlens.operators.scale import top_per_group

IGNORE_BELOW, TOLERANCE, PCT_TOLERANCE = 100, 1e-6, 0.05
MEANINGFUL_KM_GAP = 5_000

# Letters of the script, topics never given as facts, source names, loss words.
LETTERS = r"ء-ي٠-٩ٮ-ۓ۰-۹a-zA-Z"
GROUPING = ",،٬ ‏‎ "
TOPICS = {
    "warranty": ("ضمانت", "گارانتی", "وارانتی"),
    "insurance": ("بیمه",),
    "engine_condition": ("موتور سالم", "موتور تعویض", "وضعیت موتور", "گیربکس سالم"),
    "inspection": ("کارشناسی شده", "دیاگ", "پلمپ"),
    "seller": ("فروشنده معتبر", "نمایشگاه معتبر", "شخصی است", "قابل اعتماد"),
    "financing": ("اقساط", "لیزینگ", "وام", "چک"),
    "negotiation": ("قابل مذاکره", "تخفیف می‌دهد"),
    "paint": ("بدون رنگ", "رنگ‌شدگی", "دور رنگ", "تمام رنگ", "بدون تصادف", "تصادفی"),
    "options": ("فول آپشن", "آپشن کامل", "فول"),
    "paperwork": ("تعویض پلاک", "سند آزاد", "مدارک کامل"),
    "superlative": ("بهترین قیمت بازار", "کم‌کارکردترین", "بی‌نظیرترین", "تمیزترین"),
}
SOURCES = (
    "دیوار", "باما", "همراه‌مکانیک", "همراه مکانیک", "خودرو۴۵", "خودرو ۴۵",
    "ایران‌جیب", "ایران جیب", "شیپور", "اتومارکت", "بازار خودرو",
    "خودروبانک", "ماشین‌بازار", "کارنامه", "هملو",
)
LOSS_WORDS = ("از دست می‌دهی", "از دست میدهی", "از دست دادن", "را از دست", "محروم می‌شوی", "چشم‌پوشی")

OFFER = "array<struct<source_fa:string,price:bigint,mileage_km:bigint,vs_median_pct:double>>"


def numbers_in(text: Column) -> Column:
    """Distinct quantities of a text in either digit system, grouping marks removed."""
    found = F.regexp_extract_all(fold_digits(text), F.lit(rf"(\d[\d{GROUPING}]*(?:\.\d+)?)"), 1)
    plain = F.transform(found, lambda n: F.translate(n, GROUPING, "").try_cast("double"))
    return F.array_distinct(F.array_compact(plain))


def _forms(n: Column) -> Column:
    """A figure and the scaled ways to say it."""
    scaled = lambda s: F.array(n / s, F.round(n / s), F.round(n / s, 1))
    return F.concat(F.array(n), scaled(1e3), scaled(1e6), scaled(1e9))


def supported_numbers() -> Column:
    """Every figure the facts allow."""
    offers = F.col("offers")
    of = lambda name: F.transform(offers, lambda o: o[name].cast("double"))
    pct = F.array_compact(F.transform(offers, lambda o: F.abs(o["vs_median_pct"])))

    def gaps(name: str) -> Column:
        later = lambda i: F.slice(offers, i + 2, F.size(offers))
        return F.flatten(F.transform(offers, lambda a, i: F.transform(later(i), lambda b: F.abs(a[name] - b[name]).cast("double"))))

    stats = F.array(*[F.col(c).cast("double") for c in ("median_price", "min_price", "max_price", "year", "offer_count", "source_count")])
    base = F.array_compact(F.concat(of("price"), of("mileage_km"), pct, F.transform(pct, lambda p: F.round(p)), stats, gaps("price"), gaps("mileage_km")))
    title = F.filter(numbers_in(F.coalesce("title", F.lit(""))), lambda n: n == F.floor(n))
    return F.array_distinct(F.concat(F.flatten(F.transform(base, _forms)), title))


def bad_numbers(text: str = "text") -> Column:
    """Figures of 100 and more that no fact supports; needs column ``_allowed``."""
    near = lambda n: F.exists("_allowed", lambda a: F.abs(n - a) <= TOLERANCE)
    return F.filter(numbers_in(F.col(text)), lambda n: (n >= IGNORE_BELOW) & ~near(n))


def bad_percentages(text: str = "text") -> Column:
    """Percentages that are no offer's distance to the median."""
    said = F.regexp_extract_all(fold_digits(F.col(text)), F.lit(r"(\d+(?:\.\d+)?)\s*(?:٪|%|درصد)"), 1)
    said = F.array_compact(F.transform(said, lambda s: s.try_cast("double")))
    pct = F.array_compact(F.transform("offers", lambda o: F.abs(o["vs_median_pct"])))
    allowed = F.flatten(F.transform(pct, lambda v: F.array(v, F.round(v, 1), F.floor(v).cast("double"), F.ceil(v).cast("double"))))
    return F.filter(said, lambda s: ~F.exists(allowed, lambda a: F.abs(s - a) <= PCT_TOLERANCE))


def _mentioned(text: Column, phrases: Iterable[str], after: str) -> Column:
    """Which of the phrases stand in a text as whole words, found in one pass.

    At every word start the longest phrase is looked for without being consumed, so phrases
    that overlap are all seen; one that begins another comes with it. ``after`` is what
    must not follow a phrase.
    """
    longest = sorted(set(phrases), key=lambda p: (-len(p), p))
    found = F.regexp_extract_all(text, F.lit(rf"(?<![{LETTERS}])(?=({'|'.join(longest)})(?!{after}))"), 1)
    begun = {p: [q for q in longest if q != p and re.match(rf"{q}(?!{after})", p)] for p in longest}
    begun = {p: q for p, q in begun.items() if q}
    if not begun:
        return F.array_distinct(found)
    also = F.create_map(*[x for p, q in begun.items() for x in (F.lit(p), F.array(*[F.lit(w) for w in q]))])
    return F.array_distinct(F.concat(found, F.flatten(F.transform(F.filter(found, lambda p: p.isin(*begun)), lambda p: F.element_at(also, p)))))


def bad_topics(text: str = "text") -> Column:
    """Topics the text raises and the facts do not."""
    names = F.transform("offers", lambda o: F.coalesce(o["source_fa"], F.lit("")))
    given = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.array_join("flags", " "), F.array_join(names, " "))
    phrases = [p for group in TOPICS.values() for p in group]
    new = F.array_except(_mentioned(F.col(text), phrases, f"[{LETTERS}]"), _mentioned(given, phrases, f"[{LETTERS}]"))
    of = F.create_map(*[F.lit(x) for topic, group in TOPICS.items() for p in group for x in (p, topic)])
    raised = F.transform(new, lambda p: F.element_at(of, p))
    return F.filter(F.array(*[F.lit(t) for t in TOPICS]), lambda t: F.array_contains(raised, t))


def bad_sources(text: str = "text") -> Column:
    """Marketplaces named without an offer here."""
    flat = F.translate(F.col(text), HALF_SPACE, " ")
    present = F.transform("offers", lambda o: F.translate(F.coalesce(o["source_fa"], F.lit("")), HALF_SPACE, " "))
    named = _mentioned(flat, {s.replace(HALF_SPACE, " ") for s in SOURCES}, rf"[{LETTERS}0-9]|\s*[٪%]")
    return F.transform(F.array_sort(F.array_except(named, present)), lambda n: F.concat(F.lit("source:"), n))


def bad_tradeoffs(text: str = "text") -> Column:
    """Loss words about something the first offer is best at."""
    flat = F.translate(F.col(text), HALF_SPACE, " ")
    loss = flat.rlike("|".join(w.replace(HALF_SPACE, " ") for w in LOSS_WORDS)) & (F.size("offers") >= 2)
    best = F.get("offers", F.lit(0))
    least = lambda name: F.array_min(F.transform("offers", lambda o: o[name]))
    price = loss & flat.rlike("قیمت|تومان") & (best["price"] == least("price"))
    km = loss & flat.rlike("کارکرد|کیلومتر") & (best["mileage_km"] == least("mileage_km"))
    return F.array_compact(F.array(F.when(price, F.lit("loss_framing_on_price")), F.when(km, F.lit("loss_framing_on_mileage"))))


def check(rows: DataFrame, text: str = "text") -> DataFrame:
    """Add ``ok, bad_numbers, bad_topics`` to rows that hold facts and a text.

    Facts are columns: ``title, year, median_price, min_price, max_price,
    offer_count, source_count, offers, flags``; a row holds at most three offers.
    """
    staged = rows.withColumn("_allowed", supported_numbers())
    numbers = F.array_sort(F.array_distinct(F.concat(bad_numbers(text), bad_percentages(text))))
    staged = staged.withColumn("bad_numbers", numbers)
    staged = staged.withColumn("bad_topics", F.concat(bad_topics(text), bad_sources(text), bad_tradeoffs(text)))
    ok = (F.size("bad_numbers") == 0) & (F.size("bad_topics") == 0)
    return staged.withColumn("ok", ok).drop("_allowed")


def facts(cards: DataFrame, offers: DataFrame, title: Column, key: str = "spec_key", most: int = 3) -> DataFrame:
    """Decision facts of each card: its three cheapest clean offers, else any three."""
    flagged = F.size("flags") > 0
    slim = offers.select(key, flagged.alias("_flagged"), "price", "source", "source_id", "mileage_km", "vs_median_pct", F.transform("flags", lambda f: f["message"]).alias("_messages"))
    top = top_per_group(slim, [key], [F.asc("_flagged"), F.asc("price"), F.asc("source"), F.asc("source_id")], most)
    entry = F.struct("rank", "_flagged", F.struct(F.col("source").alias("source_fa"), "price", "mileage_km", "vs_median_pct").alias("o"), "_messages")
    packed = top.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_top"))
    clean = F.filter("_top", lambda t: ~t["_flagged"])
    packed = packed.withColumn("_kept", F.when(F.size(clean) > 0, clean).otherwise(F.col("_top")))
    packed = packed.select(
        key, F.transform("_kept", lambda t: t["o"]).cast(OFFER).alias("offers"), F.flatten(F.transform("_kept", lambda t: t["_messages"])).alias("flags")
    )
    stats = ["year", "median_price", "median_reliable", "min_price", "max_price", "offer_count", "source_count"]
    return cards.select(key, *stats, title.alias("title")).join(packed, key)


def fallback_text() -> Column:
    """A two-sentence explanation assembled from the facts alone."""
    best, second = F.get("offers", F.lit(0)), F.get("offers", F.lit(1))
    money = lambda c: F.format_number(c, 0)
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    pct = F.abs(F.round(best["vs_median_pct"])).cast("bigint")
    # The sentences of the explanation.
    head = join(F.col("title"), " در «", best["source_fa"], "» با قیمت ", money(best["price"]), " تومان، ")
    first = (
        F.when((pct > 0) & F.coalesce("median_reliable", F.lit(True)), join(head, pct.cast("string"), "٪ پایین‌تر از میانه‌ی ", money(F.col("median_price")), " تومانی این مدل است."))
        .when(pct > 0, join(head, "ارزان‌ترین آگهی از ", F.col("offer_count").cast("string"), " آگهی موجود است."))
        .otherwise(join(head, "نزدیک به میانه‌ی بازار است."))
    )
    gap = best["mileage_km"] - second["mileage_km"]
    trade = (
        F.when(F.size("offers") < 2, join("این مدل فقط ", F.col("offer_count").cast("string"), " آگهی دارد، پس میانه‌ی قیمت هنوز کم‌اعتبار است."))
        .when(gap >= MEANINGFUL_KM_GAP, join("در عوض ", money(gap), " کیلومتر بیشتر از گزینه‌ی بعدی (", money(second["price"]), " تومان) کار کرده است."))
        .when(F.size("flags") > 0, F.lit("در عوض داده‌ی این آگهی یک ناسازگاری دارد که پایین‌تر نشان داده شده است."))
        .when(-gap >= MEANINGFUL_KM_GAP, join("گزینه‌ی بعدی ", money(second["price"]), " تومان است و ", money(-gap), " کیلومتر بیشتر کار کرده، پس این آگهی از هر دو نظر جلوتر است."))
        .otherwise(join("تفاوت اصلی‌اش با گزینه‌ی بعدی فقط قیمت است: ", money(second["price"]), " تومان از «", F.coalesce(second["source_fa"], F.lit("منبعی دیگر")), "»."))
    )
    return F.when(F.size("offers") == 0, F.lit("برای این خودرو آگهی کافی نداریم.")).otherwise(F.concat(first, F.lit(" "), trade))
