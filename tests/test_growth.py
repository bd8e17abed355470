"""What must not grow with the tables: what goes to the driver, what is shuffled."""

import re

from pyspark.sql import functions as F

from offerlens.operators import ranking
from offerlens.operators.resolve import _hits, dictionary_matches


def test_a_compact_dictionary_file_does_not_go_to_the_driver(spark, tmp_path):
    """the size of a file says little of the aliases in it."""
    path = str(tmp_path / "words")
    spark.range(4000).select(F.concat(F.lit("mdl "), F.col("id").cast("string")).alias("alias"), F.lit("model").alias("kind"), F.lit("").alias("_of"), F.col("id").cast("string").alias("slug"), F.lit(0).alias("ord")).write.parquet(path)
    words = spark.read.parquet(path)
    texts = spark.range(300).select(F.concat(F.lit("a mdl "), F.col("id").cast("string"), F.lit(" z")).alias("t"))
    hits = _hits(texts, "t", words)
    # Only the table of heads: "mdl 1234" and shorter ones.
    joined = hits._jdf.queryExecution().sparkPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[alias", joined)
    assert sum(1 for r in hits.collect() if r.alias == f"mdl {r.t.split()[2]}") == 300


def test_aliases_are_found_at_every_place_and_length(spark):
    words = ["b", "ab", "abcdefghij", "bcd", "12", "7", "xyz 12", "fghi jklm", "m", "اب"]
    texts = ["abcdefghij", "zab", "a12b", "a123b", "12", "3 12", "xyz 12", "xyz 123", "abcdefghi jklm", "", "7", "77 7", "اب و", "bcdbcd"]
    rows = [("model", "", w, w, i) for i, w in enumerate(words)]
    folded = spark.createDataFrame(rows, "kind string, _of string, slug string, alias string, ord int")
    found = {(r.t, r.alias) for r in _hits(spark.createDataFrame([(t,) for t in texts], "t string"), "t", folded).collect()}
    want = {(t, w) for t in texts for w in words if (w in re.findall(r"\d+", t) if w.isdigit() else w in t)}
    assert found == want
    empty = spark.createDataFrame([], "kind string, brand string, slug string, alias string, ord int")
    assert dictionary_matches(spark.createDataFrame([("a",)], "t string"), "t", empty).count() == 0


def test_blocks_of_similar_cards_do_not_go_to_the_driver(spark, tmp_path):
    """the best of 16 sizes of blocks are more rows than the cards."""
    path = str(tmp_path / "cards")
    spark.range(50).select(F.col("id").alias("spec_key"), F.col("id").cast("string").alias("brand"), (F.col("id") % 7).alias("score"), (F.lit(1 << 40) + F.col("id")).alias("median_price")).write.parquet(path)
    found = ranking.similar_cards(spark.read.parquet(path))
    assert not re.search(r"BroadcastHashJoin \[(_shift|brand)", found._jdf.queryExecution().sparkPlan().toString())
    assert found.count() == 200


def test_a_span_of_many_files_loses_no_late_rows(spark, tmp_path, monkeypatch):
    """files of one span come in any order; the watermark must wait for all of them."""
    from offerlens.plans import stream_queries as SQ

    rows = spark.range(4000).select((F.col("id") % 40).alias("user_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 650).alias("ts"))
    rows = rows.withColumn("event_type", F.concat(F.lit("e"), (F.col("user_id") % 5).cast("string")))
    rows.select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts")).write.parquet(str(tmp_path / "events.parquet"))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "6"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        sessions = SQ.stream_sessions(spark, str(tmp_path)).agg(F.count(F.lit(1)), F.sum("events")).first()
        windows = SQ.stream_sliding(spark, str(tmp_path)).agg(F.sum("events")).first()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    # Every user's events lie 26,000 s apart: over six hours, so each is its own session.
    assert tuple(sessions) == (4000, 4000)
    assert windows[0] == 4 * 4000


def test_hourly_cycles_are_thinned(spark):
    """With a gap under an hour no hourly point ever goes."""
    from offerlens.plans import stream_queries as SQ
    from offerlens.plans import time_queries as T

    sf_dir = "/root/testdata/sf0.01"  # the smallest set has too few events an hour
    kept = T.history_points(spark, sf_dir)
    hours = sorted((r.spec_key, r.t) for r in kept.collect())
    assert all(a[0] != b[0] or (b[1] - a[1]).total_seconds() >= 3 * 3600 for a, b in zip(hours, hours[1:]))
    all_points = T.medians_by(spark, sf_dir, "hour").where("n >= 3").count()
    assert 0 < len(hours) < all_points
    assert sorted((r.spec_key, r.t) for r in SQ.stream_history(spark, sf_dir).collect()) == hours


def test_captures_of_one_moment_follow_the_feed(spark, sf_dir, tmp_path):
    """of captures of one listing and moment the SQL takes the smallest supplier."""
    from offerlens.plans import text_queries as TQ
    from compare import connect, difference

    # One part is 1,440 keys before another and its line ships a day later: the same moment.
    rows = [(o, 10 + (t * 1440), 20 - o + 7 * t, 1, 5.0, 30000.0 + o, 0.0, 0.0, "N", "O", f"1998-01-0{2 - t} 00:00:00") for o in range(1, 11) for t in (0, 1)]
    columns = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, d string"
    lines = spark.createDataFrame([(*r[:2], r[2] if r[0] % 2 else 30 - r[2], *r[3:]) for r in rows], columns)
    lines.select("*", F.col("d").cast("timestamp_ntz").alias("l_shipdate")).drop("d").write.parquet(str(tmp_path / "sf" / "lineitem.parquet"))
    two = spark.read.parquet(f"{sf_dir}/part.parquet").limit(1)
    two = two.select(F.explode(F.array(F.lit(10).cast("bigint"), F.lit(1450).cast("bigint"))).alias("p_partkey"), *[c for c in two.columns if c != "p_partkey"])
    two.withColumn("p_brand", F.concat(F.lit("B"), F.col("p_partkey").cast("string"))).write.parquet(str(tmp_path / "sf" / "part.parquet"))
    con = connect(str(tmp_path / "none"))
    for name in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/sf/{name}.parquet/*.parquet'")
    from offerlens.plans.registry import ORACLES

    assert difference(spark, con, TQ.listing_origins, ORACLES["listing_origins"], str(tmp_path / "sf")) == (None, 10)


def test_a_payload_is_parsed_once_and_rebuilt_only_where_it_must(spark):
    """the filter on readable payloads held a copy of the parser and of what makes the text."""
    from offerlens.operators.conform import conform
    from offerlens.sources.captures import envelope

    texts = ['{"b": 1, "a": {"z": null, "c": 2.50}}', '{"description": null, "orderId": "7"}', '{"web_info": 3}', '[1, {"description": 2}]', '"x"', "null", "{", None]
    raw = spark.createDataFrame([(i, "hamrah", t) for i, t in enumerate(texts)], "i int, source string, payload string")
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in ("city", "list_url", "fetched_at")})
    rows = envelope(raw, ("i",), parsed="parsed")
    got = {r.i: (r.source_id, r.payload) for r in rows.drop("parsed").collect()}
    assert got == {
        0: (None, '{"a":{"c":2.5,"z":null},"b":1}'), 1: ("7", '{"orderId":"7"}'), 2: (None, '{"web_info":3}'),
        3: (None, '[1,{"description":2}]'), 4: (None, '"x"'), 5: (None, "null"),
    }
    plan = conform(rows, parsed="parsed")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson(") + plan.count("parse_json(") == 1


def test_parts_are_dealt_before_their_pages_are_read(spark, sf_dir):
    """the small file of parts was one task, whatever the cores."""
    from offerlens.plans.text_queries import page_records

    assert "Exchange" in page_records(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def _market(spark):
    rows = [("a", "s1", str(i), 100 + i % 7, f"i{i}" if i % 3 else None) for i in range(300)]
    rows += [("b", None, "9", None, "none"), ("b", "s1", "1", 5, "x"), ("b", "s0", "2", 5, ""), ("c", "s2", None, 3, "n"), ("c", "s2", "0", 3, "z"), ("c", "s3", "0", 4, "y")]
    return spark.createDataFrame(rows, "spec_key string, source string, source_id string, price bigint, image string").withColumn("flags", F.array().cast("array<string>"))


def test_price_counts_are_hashed_and_images_follow_the_first_offer(spark):
    """A set of sources and a struct in the aggregate made every task sort its offers."""
    from offerlens.operators.cards import cards, price_ladder

    offers = _market(spark)
    plan = price_ladder(offers, ["spec_key", "source"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    got = {r.spec_key: (r.image, r.source_count, r.offer_count) for r in cards(offers).collect()}
    assert got == {"a": ("i112", 1, 300), "b": ("none", 2, 2), "c": ("n", 2, 3)}


def test_positions_sort_once_and_span_tasks(spark):
    """counting cells level by level shuffled the offers many times over."""
    from offerlens.operators.cards import offer_positions

    offers = _market(spark).where("price IS NOT NULL AND source_id IS NOT NULL").select("spec_key", "source", "source_id", "price", "flags").repartition(7)
    placed = offer_positions(offers)
    assert placed._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    import hashlib

    rows = placed.collect()
    for key in ("a", "b", "c"):
        mine = sorted((r for r in rows if r.spec_key == key), key=lambda r: (r.price, hashlib.md5(f"{r.source}:{r.source_id}".encode()).hexdigest()))
        assert [r.position for r in mine] == list(range(len(mine)))


def test_shuffles_of_the_tables_are_cut_fine_and_those_of_the_texts_are_not(spark):
    """With few parts a task's memory was a share of the input."""
    from offerlens.plans.session import PARTS, tune

    tune(spark, fine=True)
    assert int(spark.conf.get(PARTS)) >= 200
    rows = spark.range(0, 400000, 1, 8).groupBy((F.col("id") % 100000).alias("k")).count()
    assert rows.collect() and "coalesced" in rows._jdf.queryExecution().executedPlan().toString()
    tune(spark)
    assert spark.conf.get(PARTS, None) is None


def test_a_task_of_cards_holds_few_sorts_and_hashes(spark, tmp_path):
    """Medians, prices, images and the cards were one stage, and each operator of a task holds memory."""
    from offerlens.operators.cards import cards

    path = str(tmp_path / "offers")
    _market(spark).write.parquet(path)
    plan = cards(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and len(re.findall(r"Sort \[|HashAggregate|SortAggregate", plan)) <= 8


def test_a_small_table_of_medians_moves_no_offers(spark, tmp_path):
    """the offers were shuffled to meet medians whose size was not known yet."""
    from offerlens.operators.cards import with_deviation

    path = str(tmp_path / "offers")
    _market(spark).withColumn("flags", F.array().cast("array<struct<code:string,message:string>>")).write.parquet(path)
    found = with_deviation(spark.read.parquet(path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert {r.spec_key: r.median_price for r in found.collect()} == {"a": 103, "b": 5, "c": 3}


def test_what_only_orders_positions_is_not_written(spark, monkeypatch):
    """hashes of all offers were written with the sorted table."""
    from offerlens.operators import cards, scale

    written = []
    keep = scale.stored
    monkeypatch.setattr(scale, "stored", lambda df, name: written.append((name, df.columns)) or keep(df, name))
    offers = _market(spark).where("price IS NOT NULL AND source_id IS NOT NULL").select("spec_key", "source", "source_id", "price", "flags")
    placed = cards.offer_positions(offers)
    assert [(n, set(c)) for n, c in written] == [("ordered", {"spec_key", "source", "source_id", "price", "flags", "_at"})]
    assert placed.count() == offers.count()


def test_scans_of_the_tables_are_cut_fine_unless_the_session_says_otherwise(spark):
    """A scan of 32 MB sorted 604 MB in a task."""
    from offerlens.plans.session import SPLIT, tune

    tune(spark, fine=True)
    assert spark.conf.get(SPLIT) == "8388608b"
    tune(spark)
    assert spark.conf.get(SPLIT) == "33554432b"
    spark.conf.set(SPLIT, "5m")
    try:
        tune(spark, fine=True)
        assert spark.conf.get(SPLIT) == "5m"
    finally:
        spark.conf.unset(SPLIT)
        tune(spark)
