"""Stored tables replayed as streams until they are used up."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from offerlens.plans import bindings as B
from offerlens.plans import time_queries as T
from offerlens.plans.registry import query
from offerlens.plans.session import shared_dir
from offerlens.plans.store import new_folder, stored
from offerlens.streaming import ingest as IN
from offerlens.streaming import state as ST

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = IN.parquet_stream(spark, sf_dir, "events.parquet", EVENTS)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its input and return the rows it wrote."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/offerlens/{name}-{uuid.uuid4().hex}"
    IN.write_batches(stream, path, mode).awaitTermination()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return IN.written(spark, path, schema)


BATCHES = 3


def _replayed(df: DataFrame, name: str, key: str, ts: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Feed a derived table to ``start`` as a stream of ``BATCHES`` micro-batches in time order.

    Each batch is one span of time, dealt out by key over as many files as that takes. The
    next span is written when the stream has taken the one before, so a watermark never
    passes rows of a file that is still to come, however many files a span has. ``start``
    gets the stream and starts it from its own checkpoint.
    """
    spark = df.sparkSession
    rows = stored(df, name)
    root = new_folder(spark, f"{name}-stream")
    ends = rows.agg(F.unix_micros(F.min(F.col(ts).cast("timestamp"))).alias("lo"), F.unix_micros(F.max(F.col(ts).cast("timestamp"))).alias("hi")).first()
    lo, step = ends["lo"] or 0, ((ends["hi"] or 0) - (ends["lo"] or 0)) // BATCHES + 1
    span = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - lo) / step)
    for i in range(BATCHES):
        part = rows.where(F.coalesce(span, F.lit(0)) == i).repartition(key)
        part.write.parquet(f"{root}/span{i}")
        start(IN.parquet_stream(spark, root, "*.parquet", rows.schema, files_per_batch=None)).awaitTermination()


def _run_replayed(df: DataFrame, name: str, key: str, ts: str, work: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """The rows that ``work`` writes over a replayed table, with their ``batch_id``."""
    path = new_folder(df.sparkSession, f"{name}-out")
    fields: dict[str, str] = {}

    def start(stream: DataFrame) -> StreamingQuery:
        made = work(stream)
        fields.update({f.name: f.dataType.simpleString() for f in made.schema})
        return IN.write_batches(made, path, mode)

    _replayed(df, name, key, ts, start)
    return IN.written(df.sparkSession, path, ", ".join(f"`{n}` {kind}" for n, kind in fields.items()))


@query("stream_first_seen", "SELECT DISTINCT event_type, user_id, left(sha256(props), 16) AS content_hash FROM events")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _events(spark, sf_dir).withColumn("content_hash", F.left(F.sha2("props", 256), F.lit(16)))
    keys = ["event_type", "user_id", "content_hash"]
    return _run(IN.first_seen(hashed, "ts", "60 days", keys), "first-seen").select(*keys)


@query("stream_latest", """SELECT event_type AS source, user_id AS source_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1""")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("ts"), F.desc("event_id")]
    rows = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("source_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    path = new_folder(spark, "latest")
    _replayed(rows, "captures", "source_id", "ts", lambda stream: IN.upsert_latest(stream, path, order))
    found = IN.current(spark, path, "source string, source_id bigint, event_id bigint, ts timestamp")
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_rate_windows", T.query_sql("rate_limit_windows"))
def stream_rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = IN.request_windows(_events(spark, sf_dir), ["event_type", "user_id"], "ts", 2, "1 day", "1 day")
    rows = _run(windows, "rate", "update")
    keys = ["window_start", "event_type", "user_id"]
    last = rows.groupBy(*keys).agg(F.max_by("requests", "batch_id").alias("requests"), F.max_by("over", "batch_id").alias("over"))
    return last.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _last_batch(rows: DataFrame) -> DataFrame:
    """The rows of the newest batch of a stream that writes its whole result each time."""
    return rows.where(F.col("batch_id") == rows.agg(F.max("batch_id")).scalar())


@query("stream_sessions", f"SELECT user_id, session_start, session_end, events FROM ({T.query_sql('session_windows')})")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    work = lambda stream: IN.session_stream(stream, ["user_id"], "ts", "6 hours", "1 day")
    rows = _last_batch(_run_replayed(events, "sessions", "user_id", "ts", work, "complete"))
    return rows.select("user_id", "events", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")])


@query("stream_sliding", f"SELECT event_type, window_start, events FROM ({T.query_sql('sliding_windows')})")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    work = lambda stream: IN.sliding_stream(stream, ["event_type"], "ts", "1 hour", "15 minutes", "1 day")
    rows = _run_replayed(events, "sliding", "event_type", "ts", work, "update")
    last = rows.groupBy("event_type", "window_start").agg(F.max_by("events", "batch_id").alias("events"))
    return last.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_alerts", T.query_sql("price_alerts"))
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = T.alert_runs(spark, sf_dir).withColumn("run_at", F.col("run_at").cast("timestamp"))
    found = _run_replayed(runs, "alerts", "search_id", "run_at", ST.alert_stream)
    return T._alert_columns(found.withColumn("run_at", F.col("run_at").cast("timestamp_ntz")))


@query("stream_history", T.query_sql("history_points"))
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = T.medians_by(spark, sf_dir, "hour").withColumn("t", F.col("t").cast("timestamp"))
    work = lambda stream: ST.history_stream(stream.withWatermark("t", "1 day"), T.HOURLY_GAP)
    found = _run_replayed(points, "history", "spec_key", "t", work).where("not retired")
    from offerlens.operators.history import newest_points

    kept = newest_points(found.select("spec_key", "t", "median", "n"))
    return kept.withColumn("t", F.col("t").cast("timestamp_ntz"))


@query("stream_breaker", T.query_sql("breaker_openings").replace("SELECT user_id, event_id, ts, CAST(strikes AS BIGINT) AS strikes, ts + INTERVAL 1800 SECOND AS open_until", "SELECT CAST(user_id AS VARCHAR) AS host, ts"))
def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("host"), "ts", "event_id", F.col("event_type").isin("error", "view").alias("failed"))
    return _run(ST.breaker_stream(log), "breaker").select("host", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stream_consent", T.query_sql("consent_ledger"))
def stream_consent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final state per address out of the stream of changes; equals ``consent_ledger``."""
    changes = _run_replayed(T.consent_events(spark, sf_dir), "consent", "email", "at", ST.consent_stream)
    newest = changes.groupBy("email").agg(F.max_by(F.struct("source", "confirmed_at", "unsubscribed_at", "last_sent_at", "sends"), F.struct("changed_at", "batch_id")).alias("s"))
    return T._naive(newest.select("email", "s.*"))
