"""Streams fed in several batches, files, publishing, upkeep, and exact peers."""

import json

from pyspark.sql import functions as F

from offerlens.functions.vocabulary import published_dictionary
from offerlens.operators import accounts as A
from offerlens.operators import alerts as AL
from offerlens.operators import history as H
from offerlens.operators import maintenance as M
from offerlens.operators import ranking
from offerlens.sources import captures as S
from offerlens.sources import exports as E
from offerlens.streaming import ingest as IN
from offerlens.streaming import state as ST


def in_batches(spark, df, column, path, parts):
    """Files of consecutive rows, read one per trigger, oldest first."""
    rows = sorted(df.collect(), key=lambda r: r[column])
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_alert_state_survives_batches(spark, tmp_path):
    medians = [100, 100, 120, 100, 120, 121, 90, 120, 120, 90]
    data = [("s", "k", i * 100_000, m, i != 4, 5) for i, m in enumerate(medians)]
    runs = spark.createDataFrame(data, "search_id string, spec_key string, s long, median bigint, reliable boolean, alert_pct int")
    runs = runs.withColumn("run_at", F.timestamp_seconds("s")).drop("s")
    want = {(r.run_at, r.new_median) for r in AL.price_alerts(runs).collect()}
    stream = ST.alert_stream(in_batches(spark, runs, "run_at", str(tmp_path / "in"), 4))
    IN.write_batches(stream, str(tmp_path / "out")).awaitTermination()
    got = {(r.run_at, r.new_median) for r in IN.written(spark, str(tmp_path / "out"), ST.ALERT_SCHEMA).collect()}
    assert got == want and len(want) >= 3


def test_times_of_a_state_are_turned_once_a_batch(spark, tmp_path):
    """steps see timestamps, the store whole microseconds; nulls sort last."""
    import pandas as pd

    data = [("a", 7, "y"), ("a", 3, None), ("b", 2, "x"), ("a", 3, "x"), ("b", 9, None), ("a", 12, "z")]
    df = spark.createDataFrame(data, "k string, s long, w string").withColumn("at", F.timestamp_seconds("s"))

    def one(state, row):
        gap = None if state is None else int((row.at - state["last"]).total_seconds())
        assert state is None or isinstance(state["last"], pd.Timestamp)
        return {"last": row.at}, {"k": row.k, "w": row.w, "gap": gap}

    stream = ST.keyed_rows(in_batches(spark, df, "s", str(tmp_path / "in"), 2), "k", ["at", "w"], "k string, w string, gap bigint", one, times=("last",))
    IN.write_batches(stream, str(tmp_path / "out")).awaitTermination()
    got = {(r.k, r.w, r.gap) for r in IN.written(spark, str(tmp_path / "out"), "k string, w string, gap bigint").collect()}
    assert got == {("a", "x", None), ("a", None, 0), ("a", "y", 4), ("a", "z", 5), ("b", "x", None), ("b", None, 7)}


def test_first_seen_and_latest_over_batches(spark, tmp_path):
    data = [("a", i % 3, f"h{i % 4}", i) for i in range(24)]
    df = spark.createDataFrame(data, "source string, source_id long, content_hash string, s long").withColumn("fetched_at", F.timestamp_seconds("s"))
    stream = in_batches(spark, df, "fetched_at", str(tmp_path / "in"), 3)
    IN.write_batches(IN.first_seen(stream, "fetched_at", "1 hour"), str(tmp_path / "seen")).awaitTermination()
    seen = IN.written(spark, str(tmp_path / "seen"), "source string, source_id long, content_hash string")
    assert seen.count() == seen.distinct().count() or seen.select("source_id", "content_hash").distinct().count() == seen.count() == 12
    schema, order = "source string, source_id long, content_hash string, s long, fetched_at timestamp", [F.desc("fetched_at")]
    IN.upsert_latest(stream, str(tmp_path / "latest"), order).awaitTermination()
    assert {r.source_id: r.s for r in IN.current(spark, str(tmp_path / "latest"), schema).collect()} == {0: 21, 1: 22, 2: 23}


def test_upsert_rewrites_touched_parts_only(spark, tmp_path):
    """Many batches leave one file a part; parts without new rows keep theirs."""
    import glob

    df = spark.createDataFrame([("a", i % 40, i) for i in range(400)], "source string, source_id long, s long").withColumn("at", F.timestamp_seconds("s"))
    order, path = [F.desc("at")], str(tmp_path / "latest")
    stream = in_batches(spark, df, "s", str(tmp_path / "in"), 8)
    IN.upsert_latest(stream, path, order, buckets=4).awaitTermination()
    schema = "source string, source_id long, s long, at timestamp"
    assert {r.source_id: r.s for r in IN.current(spark, path, schema).collect()} == {i: 360 + i for i in range(40)}
    files = {f for f in glob.glob(f"{path}/rows/_part=*/*.parquet")}
    assert len(files) == len(glob.glob(f"{path}/rows/_part=*")) <= 4
    late = spark.createDataFrame([("a", 3, 999)], "source string, source_id long, s long").withColumn("at", F.timestamp_seconds("s"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    IN.upsert_latest(stream, path, order, buckets=4).awaitTermination()
    after = {f for f in glob.glob(f"{path}/rows/_part=*/*.parquet")}
    assert len(files & after) == len(files) - 1 and len(after) == len(files)
    assert {r.source_id: r.s for r in IN.current(spark, path, schema).collect()}[3] == 999


def test_history_cycles(spark):
    schema = "spec_key string, t timestamp, median bigint, n bigint"
    at = lambda s: F.timestamp_seconds(F.lit(s))
    history = spark.createDataFrame([("a", 5, 9), ("b", 6, 9)], "spec_key string, median bigint, n bigint")
    history = history.select("spec_key", at(0).alias("t"), "median", "n")
    cards = spark.createDataFrame([("a", 7, 3, True), ("b", 8, 2, False), ("c", 9, 4, True)], "spec_key string, median_price bigint, offer_count bigint, median_reliable boolean")
    keys = lambda df: sorted((r.spec_key, r.median) for r in df.collect())
    assert keys(H.append_points(history, cards, at(599), at(599))) == [("a", 5), ("b", 6), ("c", 9)]
    assert keys(H.append_points(history, cards, at(0), at(9999))) == [("a", 5), ("b", 6), ("c", 9)]
    later = H.append_points(history, cards, at(600), at(600))
    assert keys(later) == [("a", 5), ("a", 7), ("b", 6), ("c", 9)] and later.schema.simpleString() == f"struct<{schema.replace(' ', ':').replace(',:', ',')}>"
    live = cards.where("spec_key = 'a'")
    assert keys(H.retire(history, live, at(60 * 86400))) == [("a", 5)]
    assert keys(H.retire(history, live, at(60 * 86400 - 1))) == [("a", 5), ("b", 6)]


def test_capture_files(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    row = {"source": "bama", "source_id": "1", "fetched_at": "2026-01-01T00:00:00+00:00", "payload": {"detail": {"code": "1"}}}
    path.write_text(json.dumps(row) + "\n{broken\n\n" + json.dumps({**row, "source_id": "2"}) + "\n", encoding="utf-8")
    good, bad = S.read_captures(spark, str(path))
    assert sorted(r.source_id for r in good.collect()) == ["1", "2"]
    assert [r.line for r in bad.collect()] == ["{broken"]
    assert json.loads(good.first().payload) == {"detail": {"code": "1"}}


def test_publish_moves_to_the_next_manifest(spark, tmp_path):
    root = str(tmp_path)
    numbers = [E.publish(spark.range(n), root, "cards", keep=2) for n in (1, 2, 3, 4)]
    assert numbers == [1, 2, 3, 4] and E.published(spark, root, "cards").count() == 4
    assert E._manifests(spark, root, "cards") == [3, 4]
    assert len([d for d in (tmp_path / "cards" / "versions").iterdir() if not d.name.startswith(".")]) == 2


def test_two_writers_both_land_and_half_a_manifest_is_not_read(spark, tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path)
    E.publish(spark.range(1), root, "cards", keep=9)
    real = E._manifests
    # Both writers see the same last number.
    monkeypatch.setattr(E, "_manifests", lambda *a: real(*a)[:1])
    with ThreadPoolExecutor(2) as pool:
        numbers = sorted(pool.map(lambda n: E.publish(spark.range(n), root, "cards", keep=9), (5, 6)))
    monkeypatch.undo()
    assert numbers == [2, 3] and E._manifests(spark, root, "cards") == [1, 2, 3]
    assert E.published(spark, root, "cards").count() in (5, 6)
    sizes = {spark.read.parquet(f"{root}/cards/versions/{E._version(spark, root, 'cards', n)}").count() for n in numbers}
    assert sizes == {5, 6}
    (tmp_path / "cards" / "manifests" / f"{4:012d}").write_text("version abc")
    assert E.published(spark, root, "cards").count() in (5, 6)


def test_vocabulary_from_a_published_index(spark, tmp_path):
    path = tmp_path / "index.json"
    doc = {"built_at": "x", "vocab": {"brands": [{"slug": "b", "fa": "ب", "aliases": ["B", "ب"]}], "models": [{"brand": "b", "slug": "m", "fa": "م", "aliases": ["M ۱"]}]}}
    path.write_text(json.dumps(doc, ensure_ascii=False, indent=1), encoding="utf-8")
    rows = published_dictionary(spark, str(path)).collect()
    pick = lambda kind: [(r.brand, r.slug, r.label, r.alias) for r in sorted(rows, key=lambda r: r.ord) if r.kind == kind]
    assert pick("brand") == [("", "b", "ب", "B"), ("", "b", "ب", "ب")] and pick("model") == [("b", "m", "م", "M ۱")]
    assert len(pick("trim")) > 20


def test_unaddressable_index_keeps_details(spark):
    stored = spark.createDataFrame([("s", "1")], "source string, source_id string")
    fresh = stored.limit(0)
    damaged = spark.createDataFrame([("s", None)], "source string, source_id string")
    assert M.merge_details(stored, fresh, damaged).count() == 1
    assert M.merge_details(stored, fresh, damaged.limit(0)).count() == 0


def test_consent_rules(spark):
    minutes = lambda *steps: [("x", m * 60, a, "landing") for m, a in steps]
    def final(*steps):
        df = spark.createDataFrame(minutes(*steps), "email string, s long, action string, source string").withColumn("at", F.timestamp_seconds("s"))
        r = A.consent_ledger(df).first()
        return (r.confirmed_at is not None, r.unsubscribed_at is not None, r.sends)
    assert final((0, "subscribe"), (10, "subscribe"), (16, "subscribe")) == (False, False, 2)
    assert final((0, "subscribe"), (16, "subscribe"), (32, "subscribe"), (48, "subscribe")) == (False, False, 3)
    assert final((0, "subscribe"), (1, "unsubscribe"), (99, "subscribe"), (100, "confirm")) == (False, True, 1)
    assert final((0, "subscribe"), (1, "confirm"), (2, "unsubscribe"), (3, "subscribe")) == (False, False, 2)
    assert final((0, "subscribe"), (1, "confirm"), (2, "subscribe")) == (True, False, 1)


def test_similar_cards_against_brute_force(spark):
    import random

    rnd = random.Random(9)
    cards = [(f"c{i:03d}", f"b{rnd.randrange(60)}", rnd.randrange(1, 200) * 10_000_000 + rnd.randrange(99), round(rnd.random(), 6)) for i in range(150)]
    df = spark.createDataFrame(cards, "spec_key string, brand string, median_price bigint, score double")
    got = {}
    for r in ranking.similar_cards(df).orderBy("spec_key", "place").collect():
        got.setdefault(r.spec_key, []).append(r.peer)
    for key, brand, median, _ in cards:
        lo, hi = (median * 85 + 50) // 100, (median * 115 + 50) // 100
        order = lambda c: (-c[3], c[0])
        same = sorted((c for c in cards if c[1] == brand and c[0] != key), key=order)
        near = sorted((c for c in cards if c[1] != brand and lo <= c[2] <= hi), key=order)
        assert got.get(key, []) == [c[0] for c in (same + near)[:4]]


def test_lookups_read_one_bucket_and_join_without_an_exchange(spark):
    from offerlens.operators import lookup as L
    from offerlens.plans.store import bucketed

    cards = spark.range(2000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("spec_key"), F.col("id").alias("n"))
    known, history = bucketed(cards.select("spec_key"), "keys", ["spec_key"], 8), bucketed(cards.where("n % 3 = 0"), "points", ["spec_key"], 8)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    # The planner prunes buckets for a filter either way, but tells so for a bucketed scan only.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    assert "SelectedBucketsCount: 1 out of 8" in plan(history.where("spec_key = 'k42'"))
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(known.join(history, "spec_key", "left"))
        asked = spark.createDataFrame([(f"k{i}",) for i in (0, 1, 3, 9999)], "spec_key string")
        found = L.point_lookup(asked, known, history)
        # Only the asked keys are dealt out; both tables stay where they lie.
        assert plan(found).split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
        assert {r.spec_key: (r.answer, r.n) for r in found.collect()} == {"k0": ("found", 0), "k1": ("empty", None), "k3": ("found", 3), "k9999": ("not_found", None)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_captures_append_to_their_source_and_day(spark, tmp_path):
    rows = spark.createDataFrame([("bama", "1", 0), ("divar", "2", 86_400)], "source string, source_id string, s long").withColumn("fetched_at", F.timestamp_seconds("s"))
    for _ in range(2):
        S.append_captures(rows, str(tmp_path))
    assert sorted(str(d.relative_to(tmp_path)) for d in tmp_path.glob("source=*/capture_date=*")) == ["source=bama/capture_date=1970-01-01", "source=divar/capture_date=1970-01-02"]
    assert spark.read.parquet(str(tmp_path)).where("source = 'bama'").count() == 2


def test_history_retires_a_key_that_is_seen_no_more(spark, tmp_path):
    """The timer of 60 days after a key's last row fires in a later batch, once."""
    day = 86_400
    at = [("a", 0), ("b", 0), ("a", 700), ("b", 40 * day), ("b", 62 * day), ("b", 63 * day), ("b", 70 * day), ("b", 71 * day)]
    data = [(k, 10 * day + s, 5 + i) for i, (k, s) in enumerate(at)]
    points = spark.createDataFrame([(k, s, m, 3) for k, s, m in data], "spec_key string, s long, median bigint, n bigint").withColumn("t", F.timestamp_seconds("s"))
    stream = in_batches(spark, points, "s", str(tmp_path / "in"), 4).drop("s").withWatermark("t", "1 day")
    IN.write_batches(ST.history_stream(stream), str(tmp_path / "out")).awaitTermination()
    rows = IN.written(spark, str(tmp_path / "out"), ST.POINT_SCHEMA).collect()
    gone = [(r.spec_key, int(r.t.timestamp())) for r in rows if r.retired]
    assert gone == [("a", 10 * day + 700)]
    assert sorted((r.spec_key, int(r.t.timestamp())) for r in rows if not r.retired) == sorted((k, s) for k, s, _ in data)


def test_breaker_counts_on_over_batches(spark, tmp_path):
    """Three failures in a row open the breaker for 1,800 s, wherever the batches are cut."""
    data = [(0, True), (10, True), (20, True), (30, True), (40, False), (50, True), (60, True), (70, True)]
    log = spark.createDataFrame([("h", s, i, bad) for i, (s, bad) in enumerate(data)], "host string, s long, event_id long, failed boolean").withColumn("ts", F.timestamp_seconds("s"))
    IN.write_batches(ST.breaker_stream(in_batches(spark, log, "s", str(tmp_path / "in"), 4).drop("s")), str(tmp_path / "out")).awaitTermination()
    rows = IN.written(spark, str(tmp_path / "out"), ST.OPENING_SCHEMA).collect()
    assert sorted((int(r.ts.timestamp()), int(r.open_until.timestamp())) for r in rows) == [(20, 1820), (70, 1870)]
