"""Invented claims are caught and natural restatements pass."""

import pytest
from pyspark.sql import functions as F

from offerlens.operators import grounding as G

FACTS = ("پژو ۲۰۷", 1404, 2_100_000_000, True, 1_660_000_000, 2_470_000_000, 10, 3,
         [("باما", 1_660_000_000, 30_000, -21.5), ("دیوار", 1_920_000_000, 12_000, -8.6)], [])
SCHEMA = ("title string, year int, median_price bigint, median_reliable boolean, min_price bigint, max_price bigint, "
          f"offer_count bigint, source_count bigint, offers {G.OFFER}, flags array<string>, text string")

CASES = [
    ("پژو ۲۰۷ با ۱٬۶۶۰٬۰۰۰٬۰۰۰ تومان، ۲۱٪ زیر میانه.", [], []),
    ("حدود 2.1 میلیارد یا ۱۶۶۰ میلیون تومان", [], []),
    ("۱۸٬۰۰۰ کیلومتر بیشتر کار کرده", [], []),
    ("با قیمت ۱٬۵۰۰٬۰۰۰٬۰۰۰ تومان", [1_500_000_000.0], []),
    ("۴۵٪ زیر میانه", [45.0], []),
    ("ضمانت دارد", [], ["warranty"]),
    ("خودروی کوچک", [], []),
    ("در شیپور هم هست", [], ["source:شیپور"]),
    ("این خودرو ۲۲٪ ارزان‌تر است", [], []),
    ("قیمت را از دست می‌دهی", [], ["loss_framing_on_price"]),
    ("کارکرد را از دست می‌دهی", [], []),
]


def checked(spark, text, flags=()):
    row = spark.createDataFrame([(*FACTS[:-1], list(flags), text)], SCHEMA)
    return G.check(row).select("ok", "bad_numbers", "bad_topics").first()


@pytest.mark.parametrize("text, numbers, topics", CASES)
def test_check(spark, text, numbers, topics):
    got = checked(spark, text)
    assert (got.bad_numbers, got.bad_topics, got.ok) == (numbers, topics, not numbers and not topics)


def test_a_given_flag_may_be_said(spark):
    assert checked(spark, "کارشناسی شده است").bad_topics == ["inspection"]
    assert checked(spark, "کارشناسی شده است", ["این خودرو کارشناسی شده است"]).ok


def test_fallback_is_grounded(spark):
    row = spark.createDataFrame([(*FACTS, "")], SCHEMA).withColumn("text", G.fallback_text())
    got = G.check(row).first()
    assert "18,000 کیلومتر بیشتر" in got.text and got.ok
    assert row.where(F.col("text").contains("22٪ پایین‌تر")).count() == 1
