"""Rules along time, against a walk row by row; one key, hour or run holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from offerlens.operators import sequences as Q


def log(seed, n=900):
    """Two thirds of one key's rows lie in one hour, many in one second; times repeat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.7 else f"k{rng.randrange(3)}"
        at = 7200_000_000 + rng.randrange(0, 40) * 250_000 if rng.random() < 0.6 else rng.randrange(0, 3 * 86400) * 1_000_000 + rng.randrange(4) * 250_000
        rows.append((key, at, i, rng.randrange(-3, 9), rng.random() < (0.02 if key == "k0" else 0.2)))
    return rows


@pytest.mark.parametrize("levels", [Q.LEVELS, (1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000)])
def test_totals_since_the_last_reset(spark, levels):
    rows = log(1)
    df = spark.createDataFrame(rows, "k string, us bigint, id bigint, v bigint, reset boolean").withColumn("ts", F.timestamp_micros("us"))
    since = {r.id: r.t for r in Q.running_total(df, ["k"], "ts", ["id"], F.col("v"), "t", reset=F.col("reset"), levels=levels).collect()}
    before = {r.id: r.t for r in Q.running_total(df, ["k"], "ts", ["id"], F.col("v"), "t", inclusive=False, levels=levels).collect()}
    for key in {r[0] for r in rows}:
        total, whole = 0, 0
        for _, _, i, v, reset in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            assert before[i] == whole
            total, whole = (v if reset else total + v), whole + v
            assert since[i] == total
    assert Q.running_total(df.where("false"), ["k"], "ts", ["id"], F.col("v"), "t").count() == 0


def test_first_row_at_or_after(spark):
    rows = log(2)
    rng = random.Random(3)
    asked = [(rng.choice(["hot", "k0", "none"]), rng.choice(rows)[1] + rng.choice([-1, 0, 1, 900_000_000, -5_000_000_000]), i) for i in range(500)]
    df = spark.createDataFrame([r[:2] for r in rows], "k string, us bigint")
    found = Q.first_at_or_after(df, spark.createDataFrame(asked, "k string, us bigint, id bigint"), ["k"], "us", "next").collect()
    assert len(found) == len(asked)
    by_id = {r.id: r.next for r in found}
    for key, at, i in asked:
        assert by_id[i] == min((us for k, us, *_ in rows if k == key and us >= at), default=None)


@pytest.mark.parametrize("seed,gap", [(5, 600), (6, 1), (7, 86400)])
def test_thin_by_gap_follows_the_last_kept_row(spark, seed, gap):
    """One run of a key holds a third of all rows; another key has one row; a key is null."""
    rng = random.Random(seed)
    dense = [("hot", i * 30) for i in range(300)]
    data = sorted({*dense, *((f"k{rng.randrange(3)}", rng.randrange(0, 40_000)) for _ in range(500)), ("alone", 5)})
    data += [(None, s) for s in (1, 2, 700, 1400)] + [("k0", s) for k, s in data if k == "k0"][:5]
    points = spark.createDataFrame(data, "k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    found = Q.thin_by_gap(points, ["k"], "ts", gap)
    assert found.columns == ["k", "s", "ts"]
    got = sorted((str(r.k), r.s) for r in found.collect())
    want, last = set(), {}
    for k, s in sorted(data, key=lambda r: (str(r[0]), r[1])):
        if k not in last or s - last[k] >= gap:
            want.add((str(k), s))
            last[k] = s
    assert got == sorted(want)


def test_paths_are_found_by_doubling(spark):
    links = spark.createDataFrame([("a", i, i + 3) for i in range(0, 300, 3)] + [("b", 5, None)], "k string, at bigint, to bigint")
    starts = spark.createDataFrame([("a", 150), ("b", 5)], "k string, at bigint")
    got = sorted((r.k, r.at) for r in Q.reached(starts, links, ["k"], "at", "to").collect())
    assert got == [("a", i) for i in range(150, 301, 3)] + [("b", 5)]


def test_consent_ledger_against_the_rules_in_order(spark):
    """One address has a third of all events; times repeat within and across actions."""
    import pandas as pd

    from offerlens.operators import accounts as A

    rng = random.Random(11)
    weights = {"hot": (4, 2, 6, 3), "a": (0, 3, 6, 1), "b": (5, 1, 4, 2), "c": (0, 1, 8, 0), "d": (0, 1, 0, 1), "e": (1, 0, 0, 2)}
    rows = []
    for name, w in weights.items():
        for _ in range(300 if name == "hot" else 90):
            rows.append((name, rng.randrange(0, 60) * 300 if rng.random() < 0.3 else rng.randrange(0, 90_000), rng.choices(A.ACTIONS, w)[0], name))
    rows += [(f"n{i}", rng.randrange(0, 5000), rng.choice(A.ACTIONS), "s") for i in range(120) for _ in range(rng.randrange(1, 6))]
    rows += [(None, 5, "subscribe", "s"), ("x", None, "subscribe", "s"), ("y", 7, "other", "s")]
    events = spark.createDataFrame(rows, "email string, s bigint, action string, source string").withColumn("at", F.timestamp_seconds("s"))
    found = {r.email: r for r in A.consent_ledger(events).collect()}
    seconds = lambda t: None if t is None else int(t.timestamp())
    want = {}
    for name, at, action, source in sorted((r for r in rows if r[0] and r[1] is not None), key=lambda r: (r[0], r[1], r[2])):
        state = A.step(want.get(name), action, pd.Timestamp(at, unit="s"), source)
        if state is not None:
            want[name] = state
    assert set(found) == set(want) and found["hot"].sends >= 0
    for name, state in want.items():
        r = found[name]
        plain = tuple(None if state[c] is None else int(state[c].value // 10**9) for c in ("confirmed_at", "unsubscribed_at", "last_sent_at"))
        assert (tuple(seconds(t) for t in (r.confirmed_at, r.unsubscribed_at, r.last_sent_at)), r.sends, r.source) == (plain, state["sends"], state["source"]), name
    assert A.consent_ledger(events.where("false")).count() == 0


@pytest.mark.parametrize("gap", [1, 900, 86400])
def test_sessions(spark, gap):
    from offerlens.operators import windows as W

    rows = [(*r[:2], r[2], r[3]) for r in log(12)] + [(None, 5_000_000, 1, 1), (None, 5_500_000, 2, 1), ("none", None, 3, 1)]
    df = spark.createDataFrame(rows, "k string, us bigint, id bigint, v bigint").withColumn("ts", F.timestamp_micros("us"))
    found = W.sessions(df, ["k"], "ts", gap, total=F.col("v"))
    got = sorted((str(r.k), r.a, r.b, r.events, r.total) for r in found.withColumns({"a": F.unix_micros("session_start"), "b": F.unix_micros("session_end")}).collect())
    want, open_ = [], {}
    for k, us, _, v in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1])):
        held = open_.get(k)
        if held is None or us >= held[2]:
            held = open_[k] = [str(k), us, 0, 0, 0]
            want.append(held)
        held[2:] = [us + gap * 1_000_000, held[3] + 1, held[4] + v]
    assert got == sorted(tuple(w) for w in want)


def test_sliding_windows_overlap(spark):
    from offerlens.operators import windows as W

    df = spark.createDataFrame([("a", s, 1) for s in (0, 10, 29, 30, 95)], "k string, s bigint, v bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted((r.s, r.events, r.total) for r in W.sliding(df, ["k"], "ts", 60, 30, total=F.col("v")).withColumn("s", F.unix_timestamp("window_start")).collect())
    assert got == [(-30, 3, 3), (0, 4, 4), (30, 1, 1), (60, 1, 1), (90, 1, 1)]
    with pytest.raises(ValueError):
        W.sliding(df, ["k"], "ts", 60, 25)
