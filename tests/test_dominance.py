"""Best cards of many queries: dominance lists and the sweep against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.operators import dominance as D
from offerlens.operators import ranking as R

CARD_SCHEMA = """spec_key string, brand string, model string, year int, km_bucket int, median_price bigint, min_price bigint, max_price bigint,
 offer_count bigint, source_count bigint, flag_count bigint, clean_count bigint, sources array<string>"""
INTENT_SCHEMA = """query_id int, brand string, model string, gearbox string, year_min int, year_max int, price_min bigint, price_max bigint,
 sources array<string>, multi_only boolean, unflagged boolean, priority string"""


def wanted(cards, weight, k, floor):
    """Keys of the best ``k`` and the price range, by rounded score and key."""
    fit = [c for c in cards if floor is None or c[2] >= floor]
    if not fit:
        return None
    lo, hi = min(c[0] for c in fit), max(c[0] for c in fit)
    score = lambda c: round(weight * (1 - ((c[0] - lo) / (hi - lo) if hi > lo else 0.5)) + c[1], 6)
    return lo, hi, {c[3] for c in sorted(fit, key=lambda c: (-score(c), c[3]))[:k]}


@pytest.mark.parametrize("floors", [False, True])
@pytest.mark.parametrize("values", [4, 1000])
def test_list_holds_the_best_of_every_query(floors, values):
    rng = random.Random(values + floors)
    for k in (1, 3, 24):
        cards = [(rng.randrange(values), rng.randrange(values) / values, rng.randrange(values), f"k{i:04d}") for i in range(1500)]
        span = max(c[0] for c in cards) - min(c[0] for c in cards)
        front, seen = D.Front(k, 0.4, span, floors), []
        while len(seen) < len(cards):
            part = cards[len(seen) : len(seen) + rng.choice([1, 7, 300])]
            front.add(np.array([c[0] for c in part]), np.array([c[1] for c in part]), np.array([c[2] for c in part]), np.array([c[3] for c in part], object))
            seen += part
            for floor in [None, *(rng.randrange(values + 2) for _ in range(2))] if floors else [None]:
                want, got = wanted(seen, 0.4, k, floor), front.ask(floor)
                assert (want is None) == (got is None)
                if want:
                    assert got[:2] == want[:2] and want[2] <= set(got[2].tolist())
        front.settle()
        assert front.n == len(cards) and (floors or len(front.median) < len(cards) / 2 or k > 20)


def market(seed, n):
    rng = random.Random(seed)
    cards = []
    for i in range(n):
        low = rng.randrange(10, 60) * 10
        brand = "hot" if rng.random() < 0.6 else f"b{rng.randrange(4)}"
        sources = sorted(rng.sample(["s1", "s2", "s3"], rng.randrange(1, 4)))
        high = low + rng.randrange(0, 30) * 10
        cards.append((f"c{i:04d}", brand, f"m{rng.randrange(2)}", rng.randrange(1380, 1405), rng.choice([None, 1, 5, 9]), (low + high) // 2, low, high, 4, len(sources), rng.randrange(5), rng.randrange(2), sources))
    return cards


def intents(seed, n):
    rng = random.Random(seed)
    pick = lambda p, value: value if rng.random() < p else None
    return [
        (i, pick(0.6, rng.choice(["hot", "b1", "none"])), pick(0.3, "m1"), None, pick(0.3, 1390), pick(0.3, 1400), pick(0.4, rng.randrange(0, 900)), pick(0.8, rng.randrange(50, 900)),
         pick(0.3, ["s1", "s3"]), rng.random() < 0.3, rng.random() < 0.3, rng.choice(["relevant", "cheapest", "odd"]))
        for i in range(n)
    ]


def plain(cards, intent, k, scale):
    _, brand, model, _, first, last, floor, ceiling, sources, multi, clean, priority = intent
    fit = [
        c for c in cards
        if (brand in (None, c[1])) and (brand is None or model is None or model == c[2]) and (model is None or model == c[2]) and (first is None or c[3] >= first) and (last is None or c[3] <= last)
        and (floor is None or c[7] >= floor) and (ceiling is None or c[6] <= ceiling) and (sources is None or set(sources) & set(c[12])) and (not multi or c[9] > 1) and (not clean or c[11] > 0)
    ]
    if not fit:
        return []
    w = dict(zip(R.FACTORS, R.MODES[priority if priority in R.MODES else "relevant"]))
    lo, hi = min(c[5] for c in fit), max(c[5] for c in fit)
    clamp = lambda x: min(max(x, 0.0), 1.0)

    def score(c):
        price = (c[5] - lo) / (hi - lo) if hi > lo else 0.5
        mileage = 0.5 if c[4] is None else 1 - clamp(c[4] / scale.buckets)
        age = clamp((c[3] - scale.first_year) / (scale.last_year - scale.first_year))
        return round(w["price"] * (1 - price) + w["mileage"] * mileage + w["age"] * age + w["corroborate"] * clamp((c[9] - 1) / (scale.sources - 1)) + w["integrity"] * clamp(1 - c[10] / c[8]), 6)

    best = sorted(fit, key=lambda c: (-score(c), c[0]))[:k]
    return [(c[0], score(c), len(fit)) for c in best]


@pytest.mark.parametrize("chunk", [16, 1 << 14])
def test_every_query_of_a_batch(spark, monkeypatch, chunk):
    """One brand has most cards; limits tie with prices, some floors lie above the ceiling."""
    monkeypatch.setattr(D, "CHUNK", chunk)
    cards, asked, scale = market(3, 260), intents(4, 120), R.Scale()
    found = {}
    for r in R.rank_many(spark.createDataFrame(cards, CARD_SCHEMA), spark.createDataFrame(asked, INTENT_SCHEMA), 6, scale).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.spec_key, r.score, r.total))
    for intent in asked:
        got = [(key, score, total) for _, key, score, total in sorted(found.get(intent[0], []))]
        everyone = plain(cards, intent, len(cards), scale)
        assert len(got) == min(6, len(everyone)), intent
        exact = {key: score for key, score, _ in everyone}
        for (key, score, total), (_, best, _) in zip(got, everyone):
            # The last digit of a half may round either way.
            assert total == len(everyone) and abs(score - exact[key]) < 2e-6 and abs(score - best) < 2e-6, intent
    assert sum(1 for i in asked if i[6] is not None and i[7] is not None and i[6] > i[7]) > 5


def test_no_cards_and_no_queries(spark):
    none = spark.createDataFrame([], CARD_SCHEMA)
    asked = spark.createDataFrame(intents(1, 5), INTENT_SCHEMA)
    assert R.rank_many(none, asked).count() == 0
    assert R.rank_many(spark.createDataFrame(market(1, 5), CARD_SCHEMA), asked.where("false")).count() == 0


def test_no_join_of_queries_with_cards(spark):
    """Cards meet sets of queries; what meets a query is its own short list."""
    cards = spark.createDataFrame(market(5, 400), CARD_SCHEMA)
    many = [(i, None, None, None, None, None, None, 100 + i, None, False, False, "value") for i in range(300)]
    found = R.rank_many(cards, spark.createDataFrame(many, INTENT_SCHEMA), 5)
    assert found.count() == 300 * 5
    assert found.select(F.countDistinct("query_id")).first()[0] == 300
