"""Contradictions inside one record, reported and never repaired."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.text import contains_any

# Labels of repaired bodywork and phrases that change what a price means.
WORKED_ON = ("رنگ‌شدگی", "تمام‌رنگ", "تعویض")
NOT_A_CAR_YET = (
    "حواله", "پیش فروش", "پیش‌فروش", "پیش خرید", "پیش‌خرید",
    "مشارکت در تولید", "قرعه کشی", "قرعه‌کشی", "ثبت نام", "ثبت‌نام",
)
INSTALMENT = ("اقساط", "قسطی", "پیش پرداخت", "پیش‌پرداخت", "چک و سند")
OFF_MARKET = ("فروش دولتی", "فروش سازمانی")

FLAG_TYPE = "array<struct<code:string,message:string>>"


@dataclass(frozen=True)
class FlagRules:
    """Thresholds of the record rules; the defaults are the published ones."""

    current_year: int = 1405
    implausible_km: int = 800_000
    zero_km_grace_years: int = 2
    max_km_per_year: int = 60_000
    worked_on: tuple[str, ...] = WORKED_ON
    not_a_car_yet: tuple[str, ...] = NOT_A_CAR_YET
    instalment: tuple[str, ...] = INSTALMENT
    off_market: tuple[str, ...] = OFF_MARKET


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def record_flags(rules: FlagRules, km: Column, year: Column, body: Column, title: Column, price: Column) -> Column:
    """``array<struct<code, message>>`` for one record."""
    shown_km, shown_year = F.format_number(km, 0), year.cast("string")
    age = F.lit(rules.current_year) - year
    per_year = F.format_number(F.floor(km / F.when(age > 0, age)), 0)
    # The codes and sentences of the findings.
    findings = [
        ("mileage_sentinel", km >= rules.implausible_km,
         _text("کارکرد ", shown_km, " کیلومتر واقعی به نظر نمی‌رسد؛ احتمالاً «نامشخص» ثبت شده.")),
        ("zero_km_old_car", (km == 0) & (age > rules.zero_km_grace_years),
         _text("خودروی مدل ", shown_year, " با کارکرد صفر ثبت شده است.")),
        ("zero_km_with_bodywork", (km == 0) & body.isin(*rules.worked_on),
         _text("کارکرد صفر اعلام شده اما بدنه «", body, "» دارد.")),
        ("mileage_vs_age", (km > 0) & (age > 0) & (km > age * rules.max_km_per_year),
         _text("میانگین ", per_year, " کیلومتر در سال برای مدل ", shown_year, " غیرعادی است.")),
        ("not_a_car_yet", contains_any(title, rules.not_a_car_yet),
         _text("این آگهی حواله یا پیش‌فروش است، نه خودروی آماده‌ی تحویل؛ قیمتش با آگهی‌های دیگر قابل مقایسه نیست.")),
        ("instalment_price", contains_any(title, rules.instalment),
         _text("این آگهی اقساطی است؛ عدد اعلام‌شده معمولاً پیش‌پرداخت است، نه قیمت کامل خودرو، و با بقیه قابل مقایسه نیست.")),
        ("off_market_sale", contains_any(title, rules.off_market),
         _text("این آگهی «فروش دولتی یا سازمانی» است؛ عدد اعلام‌شده قیمت خرید خودرو در بازار نیست و با آگهی‌های دیگر قابل مقایسه نیست.")),
        ("no_price", price.isNull(), _text("قیمت معتبری اعلام نشده است.")),
    ]
    cells = [F.when(hit, F.struct(F.lit(code).alias("code"), message.alias("message"))) for code, hit, message in findings]
    return F.array_compact(F.array(*cells)).cast(FLAG_TYPE)


def outlier_flag(price: Column, median: Column) -> Column:
    """The finding that needs the whole cohort."""
    # Fixed value: the sentence of this finding.
    message = _text(
        "قیمت این آگهی ", F.format_number(price, 0), " تومان است، در حالی که میانه‌ی همین خودرو ",
        F.format_number(median, 0), " تومان است؛ ممکن است حواله، پیش‌فروش یا قیمت غیرواقعی باشد.",
    )
    return F.struct(F.lit("price_outlier").alias("code"), message.alias("message"))


def flag_rows(offers: DataFrame, keep: list[str], flags: str = "flags") -> DataFrame:
    """One row per finding."""
    return offers.select(*keep, F.explode(flags).alias("_f")).select(*keep, "_f.code", "_f.message")


def flag_histogram(offers: DataFrame, keys: list[str], flags: str = "flags") -> DataFrame:
    """Findings per group and code, with one message to show."""
    rows = flag_rows(offers, keys, flags)
    return rows.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n"), F.min("message").alias("message"))
