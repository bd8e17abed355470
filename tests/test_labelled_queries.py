"""Accuracy of the query rules on queries labelled by hand."""

import pytest
from pyspark.sql import functions as F

from offerlens.functions.vocabulary import Alias, Vocabulary
from offerlens.operators.intents import parse_queries
from offerlens.operators.quality import evaluate

VOCAB = Vocabulary(
    (Alias("alpha", "alpha", 0), Alias("alpha", "آلفا", 1), Alias("alpha", "الفا", 2), Alias("beta", "beta", 3), Alias("beta", "بتا", 4), Alias("gamma", "گاما", 5)),
    (Alias("206", "206", 0, "alpha"), Alias("206-sd", "206 sd", 1, "alpha"), Alias("x1", "x1", 2, "beta"), Alias("x1", "x 1", 3, "beta"), Alias("sahra", "صحرا", 4, "gamma")),
)
FIELDS = ("brand", "model", "gearbox", "priority", "price_min", "price_max", "year_min", "year_max")

# query, and the fields that a reader takes from it; "" means: asks for nothing there.
LITERAL = [
    ("آلفا 206", dict(brand="alpha", model="206")), ("بتا x1", dict(brand="beta", model="x1")), ("گاما صحرا", dict(brand="gamma", model="sahra")),
    ("آلفا 206 اتوماتیک", dict(model="206", gearbox="at")), ("بتا دنده‌ای", dict(brand="beta", gearbox="mt")),
    ("آلفا زیر 500 میلیون", dict(brand="alpha", price_max="500000000")), ("بتا تا 2 میلیارد", dict(brand="beta", price_max="2000000000")),
    ("حداکثر 900 میلیون", dict(price_max="900000000", price_min="")), ("آلفا بین 300 تا 400 میلیون", dict(price_min="300000000", price_max="400000000")),
    ("بتا بالای 700 میلیون", dict(price_min="700000000", price_max="")), ("آلفا مدل 1398", dict(year_min="1398", year_max="1398")),
    ("آلفا مدل 95 تا 99", dict(year_min="1395", year_max="1399")), ("بتا بالای مدل 1400", dict(year_min="1400", year_max="")),
    ("ارزان‌ترین آلفا", dict(brand="alpha", priority="cheapest")), ("آلفا کم کارکرد", dict(priority="lowkm")), ("بهترین بتا", dict(priority="value")),
    ("گاما", dict(brand="gamma", model="", gearbox="", price_max="", year_min="")),
]
HARD = [
    ("آلفا ۲۰۶ زیر ۵۰۰ میلیون", dict(model="206", price_max="500000000")), ("206 sd", dict(brand="alpha", model="206-sd")),
    ("صحرا اتومات", dict(brand="gamma", model="sahra", gearbox="at")), ("beta x 1 manual", dict(brand="beta", model="x1")),
    ("بتا زیر 1.5 میلیارد", dict(price_max="1500000000")), ("آلفا تا 800", dict(price_max="800000000")),
    ("ارزون ترین بتا مدل 1402", dict(priority="cheapest", year_min="1402", year_max="1402")), ("آلفا مدل 2019", dict(year_min="1398", year_max="1398")),
    ("بتا 2020 اتوماتیک", dict(year_min="1399", gearbox="at")), ("آلفا 2060", dict(brand="alpha", model="")),
    ("گاما بین 1 و 2 میلیارد", dict(price_min="1000000000", price_max="2000000000")), ("آلفا کمتر از 450 میلیون کم کارکرد", dict(price_max="450000000", priority="lowkm")),
    ("بتا از 600 میلیون", dict(price_min="600000000")), ("مدل 85 الی 90 آلفا", dict(year_min="1385", year_max="1390")),
    ("ALPHA 206 SD", dict(brand="alpha", model="206-sd")), ("الفا،206", dict(brand="alpha", model="206")),
    ("بتا-x1-اتوماتیک", dict(brand="beta", model="x1", gearbox="at")), ("آلفا مدل 05", dict(year_min="1405", year_max="1405")),
]
MESSY = [
    ("سلام یه آلفا ۲۰۶ میخوام زیر ۶۰۰ میلیون باشه", dict(brand="alpha", model="206", price_max="600000000")), ("بتاا x1", dict(model="x1")),
    ("ماشین ارزون تا 400 تومن", dict(price_max="400000000", priority="cheapest")), ("206 تمیز کم‌کارکرد دنده ای", dict(model="206", priority="lowkm", gearbox="mt")),
    ("آلفا 206sd اتومات", dict(brand="alpha", gearbox="at")), ("بتا مدل 1400 به بالا", dict(year_min="1400")), ("گاما صحرا / بتا", dict(model="sahra")),
    ("یه چیز مناسب تا 1 میلیارد", dict(priority="value", price_max="1000000000")), ("آلفا۲۰۶مدل۹۸", dict(model="206", year_min="1398")),
    ("beta    X1   زیر  ٩٠٠  میلیون", dict(brand="beta", model="x1", price_max="900000000")), ("خودرو دنده اتومات آلفا", dict(brand="alpha", gearbox="at")),
    ("نیم میلیارد پول دارم", dict(price_max="500000000")),
]


@pytest.mark.parametrize(("cases", "goal"), [(LITERAL, 100), (HARD, 100), (MESSY, 83)], ids=["literal", "hard", "messy"])
def test_accuracy(spark, cases, goal):
    rows = [(i, q, *[want.get(f) for f in FIELDS]) for i, (q, want) in enumerate(cases)]
    given = spark.createDataFrame(rows, "query_id int, q string, " + ", ".join(f"want_{f} string" for f in FIELDS))
    parsed = parse_queries(given, VOCAB)
    graded = parsed.select("q", *[c for c in parsed.columns if c.startswith("want_")], *[parsed[f].alias(f"got_{f}") for f in FIELDS])
    report = {r["metric"]: r for r in evaluate(graded, FIELDS).collect()}
    wrong = [(r["q"], {f: r[f"got_{f}"] for f, w in want.items() if str(r[f"got_{f}"] or "") != w}) for r, (_, want) in zip(graded.collect(), cases)]
    assert report["case"]["n"] == len(cases)
    assert report["case"]["correct"] * 100 >= goal * len(cases), [w for w in wrong if w[1]]


def test_cases_are_worked_out_once_for_accuracy_and_latency(spark):
    """F16: both aggregates read stored marks, not the parsing behind them."""
    cases = spark.range(10).select(
        F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 1).alias("got_a"), F.when(F.col("id") < 8, F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 1)).alias("want_a"),
        (F.col("id") * 10).alias("latency"),
    )
    report = evaluate(cases, ("a",), "latency")
    assert "sha2" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.metric, r.n, r.correct, r.pct) for r in report.collect()} == {
        ("case", 10, 10, 100.0), ("a", 8, 8, 100.0), ("latency_p50", 10, None, 45.0), ("latency_p95", 10, None, 90.0)
    }
