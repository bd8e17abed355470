"""Queries over time: history, alerts, rates, failure runs, budgets, accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions.labels import age_label
from offerlens.functions.text import clamp_label
from offerlens.operators import accounts as A
from offerlens.operators import alerts as AL
from offerlens.operators import history as H
from offerlens.operators import quality as Q
from offerlens.operators import windows as W
from offerlens.operators.scale import exact_median
from offerlens.plans import bindings as B
from offerlens.plans.registry import ORACLES, query
from offerlens.plans.store import stored
from offerlens.sources.captures import page_title


def query_sql(name: str) -> str:
    """The SQL of a registered query, for a second query with the same answer."""
    return ORACLES[name]


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def medians_by(spark: SparkSession, sf_dir: str, step: str) -> DataFrame:
    """One candidate point per event type and time step: median value in cents."""
    events = B.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("spec_key"), F.date_trunc(step, "ts").cast("timestamp_ntz").alias("t"), F.round(F.col("value") * 100).cast("bigint").alias("cents")
    )
    return exact_median(events, ["spec_key", "t"], "cents").select("spec_key", "t", "median", "n")


def points_sql(step: str) -> str:
    return f"""SELECT event_type AS spec_key, date_trunc('{step}', ts)::TIMESTAMP AS t, CAST(floor(median(CAST(round(value * 100) AS BIGINT))) AS BIGINT) AS median, count(*) AS n
    FROM events GROUP BY 1, 2"""


def replay_sql(step: str, reliable: int, gap_seconds: int = H.MIN_GAP_SECONDS) -> str:
    return f"""WITH RECURSIVE p AS (SELECT * FROM ({points_sql(step)}) WHERE n >= {reliable}),
nxt AS (SELECT a.spec_key, a.t, min(b.t) AS nt FROM p a JOIN p b ON a.spec_key = b.spec_key AND b.t >= a.t + INTERVAL {gap_seconds} SECOND GROUP BY 1, 2),
k AS (SELECT spec_key, min(t) AS t FROM p GROUP BY 1 UNION ALL SELECT k.spec_key, nxt.nt FROM k JOIN nxt ON k.spec_key = nxt.spec_key AND k.t = nxt.t)
SELECT p.* FROM p JOIN k USING (spec_key, t) QUALIFY row_number() OVER (PARTITION BY p.spec_key ORDER BY p.t DESC) <= {H.MAX_POINTS}"""


#: Cycles come every hour here, so a gap under an hour would thin out nothing.
HOURLY_GAP = 3 * 3600


@query("history_points", replay_sql("hour", 3, HOURLY_GAP))
def history_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.replay(medians_by(spark, sf_dir, "hour"), gap_seconds=HOURLY_GAP)


@query("history_dense", replay_sql("minute", 1))
def history_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cycle every minute: most points lie within the gap of a kept one."""
    return H.replay(medians_by(spark, sf_dir, "minute"), reliable=1)


@query("history_append", f"""WITH p AS ({points_sql('day')}), last AS (SELECT max(t) AS cut FROM p), h AS (SELECT p.* FROM p, last WHERE t < cut),
c AS (SELECT p.* FROM p, last WHERE t = cut AND n >= 3), u AS (SELECT * FROM h UNION ALL SELECT * FROM c)
SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY spec_key ORDER BY t DESC) <= 240""")
def history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days but the last are the stored history, the last day is this cycle."""
    points = stored(medians_by(spark, sf_dir, "day"), "day-points")
    cut = points.agg(F.max("t").alias("t")).first()["t"]
    cycle = points.where(F.col("t") == F.lit(cut))
    cards = cycle.select("spec_key", F.col("median").alias("median_price"), F.col("n").alias("offer_count"), (F.col("n") >= 3).alias("median_reliable"))
    return H.append_points(points.where(F.col("t") < F.lit(cut)), cards, F.lit(cut), F.lit(cut))


@query("history_retired", """WITH h AS (SELECT user_id AS spec_key, date_trunc('day', ts)::TIMESTAMP AS t, count(*) AS n FROM events GROUP BY 1, 2),
gone AS (SELECT spec_key FROM h GROUP BY 1 HAVING floor(epoch(TIMESTAMP '2024-03-27' - max(t)) / 86400) >= 60 AND spec_key NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase'))
SELECT spec_key, t, n FROM h WHERE spec_key NOT IN (SELECT spec_key FROM gone)""")
def history_retired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's days; buyers are still in the index."""
    events = B.table(spark, sf_dir, "events")
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    history = events.groupBy(F.col("user_id").alias("spec_key"), day.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    live = events.where(F.col("event_type") == "purchase").select(F.col("user_id").alias("spec_key"))
    return H.retire(history, live, _ts("2024-03-27"))


@query("price_history_xy", f"""WITH p AS ({points_sql('day')}), e AS (SELECT *, min(median) OVER w AS lo, max(median) OVER w AS hi, epoch_us(min(t) OVER w) AS t0, epoch_us(max(t) OVER w) AS t1
  FROM p WINDOW w AS (PARTITION BY spec_key))
SELECT spec_key, t, round(100 - CASE WHEN t1 > t0 THEN (epoch_us(t) - t0)::DOUBLE / (t1 - t0) ELSE 0.5 END * 100, 2) AS x,
  round(CASE WHEN hi > lo THEN 8 + (1 - (median - lo)::DOUBLE / (hi - lo)) * 84 ELSE 50 END, 2) AS y FROM e""")
def price_history_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.chart(medians_by(spark, sf_dir, "day"))


# --- alerts -------------------------------------------------------------------

RUNS = """runs AS (SELECT event_type || user_id % 20 AS search_id, event_type AS spec_key, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01') AS run_at,
  CAST(floor(median(CAST(round(value * 100) AS BIGINT))) AS BIGINT) // 1000 * 1000 AS median, count(*) >= 3 AS reliable FROM events GROUP BY 1, 2, 3),
q AS (SELECT *, lag(median) OVER (PARTITION BY search_id ORDER BY run_at) AS old_median FROM runs WHERE reliable),
c AS (SELECT search_id, spec_key, run_at, old_median, median AS new_median, round((median - old_median) * 100.0 / old_median, 6) AS pct FROM q
  WHERE old_median > 0 AND abs((median - old_median) * 100.0 / old_median) >= 5)"""


def alert_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each watched search saw twice a day; coarse medians, so values repeat."""
    half_day = F.window(F.col("ts").cast("timestamp"), "12 hours")["start"].cast("timestamp_ntz")
    events = B.table(spark, sf_dir, "events").select(
        F.concat("event_type", (F.col("user_id") % 20).cast("string")).alias("search_id"), F.col("event_type").alias("spec_key"),
        half_day.alias("run_at"), F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )
    runs = exact_median(events, ["search_id", "spec_key", "run_at"], "cents")
    coarse = (F.floor(F.col("median") / 1000) * 1000).cast("bigint")
    return runs.select("search_id", "spec_key", "run_at", coarse.alias("median"), (F.col("n") >= 3).alias("reliable"), F.lit(5).cast("decimal(5,2)").alias("alert_pct"))


def _alert_columns(df: DataFrame) -> DataFrame:
    return df.select("search_id", "spec_key", "run_at", "old_median", "new_median", F.round("pct", 6).alias("pct"))


@query("price_alert_candidates", f"WITH {RUNS} SELECT * FROM c")
def price_alert_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alert_columns(AL.candidates(alert_runs(spark, sf_dir)))


@query("price_alerts", f"""WITH RECURSIVE {RUNS},
nxt AS (SELECT a.search_id, a.spec_key, a.new_median, a.run_at, min(b.run_at) AS nt FROM c a JOIN c b ON a.search_id = b.search_id AND a.spec_key = b.spec_key
  AND a.new_median = b.new_median AND b.run_at >= a.run_at + INTERVAL 7 DAY GROUP BY 1, 2, 3, 4),
k AS (SELECT search_id, spec_key, new_median, min(run_at) AS run_at FROM c GROUP BY 1, 2, 3
  UNION ALL SELECT k.search_id, k.spec_key, k.new_median, nxt.nt FROM k JOIN nxt USING (search_id, spec_key, new_median, run_at))
SELECT c.* FROM c JOIN k USING (search_id, spec_key, new_median, run_at)""")
def price_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alert_columns(AL.price_alerts(alert_runs(spark, sf_dir)))


@query("alert_repeats", f"""WITH {RUNS} SELECT * FROM c WHERE run_at >= TIMESTAMP '2024-01-15' AND NOT EXISTS (SELECT 1 FROM c s WHERE s.run_at < TIMESTAMP '2024-01-15'
  AND s.search_id = c.search_id AND s.spec_key = c.spec_key AND s.new_median = c.new_median AND s.run_at > c.run_at - INTERVAL 7 DAY)""")
def alert_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = AL.candidates(alert_runs(spark, sf_dir))
    sent = found.where(F.col("run_at") < _ts("2024-01-15")).select("search_id", "spec_key", "new_median", F.col("run_at").alias("sent_at"))
    return _alert_columns(AL.not_recently_sent(found.where(F.col("run_at") >= _ts("2024-01-15")), sent))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_add("HOUR", (F.col("c_custkey") % 1000).cast("int"), _ts("2024-01-01"))
    return B.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.concat(F.when(F.col("c_custkey") % 11 == 0, "=").otherwise(""), F.lower("c_name")).alias("email"),
        F.when(F.col("c_acctbal") > 0, at).alias("verified_at"), (F.col("c_mktsegment") == "BUILDING").alias("marketing_consent"), at.alias("created_at"),
    )


USERS = """users AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 11 = 0 THEN '=' ELSE '' END || lower(c_name) AS email, TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 1000 AS INTEGER)) AS created_at,
  CASE WHEN c_acctbal > 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 1000 AS INTEGER)) END AS verified_at, c_mktsegment = 'BUILDING' AS marketing_consent FROM customer)"""
SUBSCRIBERS = """subscribers AS (SELECT email, CASE WHEN user_id % 5 = 0 THEN '@tag' ELSE 'landing' END AS source, CASE WHEN verified_at IS NOT NULL AND user_id % 4 <> 0 THEN created_at END AS confirmed_at,
  CASE WHEN user_id % 7 = 0 THEN created_at END AS unsubscribed_at FROM users WHERE user_id % 3 <> 0)"""


def _subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _users(spark, sf_dir).where("user_id % 3 <> 0")
    return u.select(
        "email", F.when(F.col("user_id") % 5 == 0, "@tag").otherwise("landing").alias("source"),
        F.when(F.col("verified_at").isNotNull() & (F.col("user_id") % 4 != 0), F.col("created_at")).alias("confirmed_at"),
        F.when(F.col("user_id") % 7 == 0, F.col("created_at")).alias("unsubscribed_at"),
    )


def _saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "O", F.lit(5).cast("decimal(5,2)")).alias("alert_pct"),
        F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate")).alias("last_run_at"),
    )


@query("due_alerts", f"""WITH {USERS} SELECT o_orderkey AS id, user_id, email, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS last_run_at
FROM orders JOIN users ON user_id = o_custkey WHERE o_orderstatus = 'O' AND verified_at IS NOT NULL ORDER BY 4 NULLS FIRST, 1 LIMIT 200""")
def due_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AL.due_searches(_saved_searches(spark, sf_dir), _users(spark, sf_dir)).select("id", "user_id", "email", "last_run_at")


# --- rates, failures, budgets ---------------------------------------------------


@query("rate_limit_windows", """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, user_id, count(*) AS requests, greatest(count(*) - 2, 0) AS over
FROM events GROUP BY 1, 2, 3""")
def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.rate_windows(B.table(spark, sf_dir, "events"), ["event_type", "user_id"], "ts", "1 day", 2)
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


ISLANDS = """e AS (SELECT *, sum(CASE WHEN {ok} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
s AS (SELECT *, CASE WHEN {ok} THEN 0 ELSE sum(CASE WHEN {ok} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) END AS strikes FROM e)"""


@query("breaker_openings", f"""WITH {ISLANDS.format(ok="event_type NOT IN ('error', 'view')")}
SELECT user_id, event_id, ts, CAST(strikes AS BIGINT) AS strikes, ts + INTERVAL 1800 SECOND AS open_until FROM s WHERE strikes > 0 AND strikes % 3 = 0""")
def breaker_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    found = Q.breaker_openings(events, "user_id", "ts", ["event_id"], F.col("event_type").isin("error", "view"))
    return found.select("user_id", "event_id", "ts", "strikes", "open_until")


@query("login_lockouts", f"""WITH {ISLANDS.format(ok="event_type = 'signup'")} SELECT user_id, event_id, CAST(strikes AS BIGINT) AS strikes, ts + INTERVAL 900 SECOND AS locked_until FROM s WHERE strikes >= 8""")
def login_lockouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return Q.lockouts(events, "user_id", "ts", ["event_id"], F.col("event_type") != "signup").select("user_id", "event_id", "strikes", "locked_until")


# Invented prices of three models; the others have none and cost nothing.
RATES = [("m1", 0.32, 1.75), ("m2", 4.4, 13.2), ("m4", 0.07, 0.21)]
USAGE = f"""u AS (SELECT event_id, ts, 'm' || user_id % 5 AS model, CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 AS tin, event_id % 7 * 50 AS tout, event_type FROM events),
usage AS (SELECT u.*, CAST(round(tin * coalesce(i, 0::DOUBLE) + tout * coalesce(o, 0::DOUBLE)) AS BIGINT) AS cost_micros FROM u
  LEFT JOIN (VALUES {', '.join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in RATES)}) r(model, i, o) USING (model))"""


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    usage = B.table(spark, sf_dir, "events").select(
        "event_id", "ts", F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model"),
        (F.get_json_object("props", "$.k").cast("bigint") * 100).alias("tokens_in"), (F.col("event_id") % 7 * 50).alias("tokens_out"),
        F.when(kind == "click", "call").when(kind == "view", "cache_hit").when(kind == "error", "rejected").when(kind == "signup", "fallback").otherwise("call").alias("outcome"),
    )
    return Q.priced(usage, spark.createDataFrame(RATES, "model string, rate_in double, rate_out double"))


@query("daily_budget_cutoff", f"""WITH {USAGE}, s AS (SELECT *, coalesce(sum(cost_micros) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM usage)
SELECT event_id, cost_micros, CAST(b AS BIGINT) AS spent_before, b < 500000 AS allowed FROM s""")
def daily_budget_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.budget_cutoff(_usage(spark, sf_dir), "ts", ["event_id"], ceiling=500_000).select("event_id", "cost_micros", "spent_before", "allowed")


@query("usage_rollup", f"""WITH {USAGE} SELECT CAST(ts AS DATE) AS day, CAST(sum(cost_micros) AS BIGINT) AS spend_micros, count(*) FILTER (event_type IN ('click', 'purchase')) AS calls,
  count(*) FILTER (event_type = 'view') AS cache_hits, count(*) FILTER (event_type = 'error') AS rejections, count(*) FILTER (event_type = 'signup') AS fallbacks FROM usage GROUP BY 1""")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.usage_rollup(_usage(spark, sf_dir))


@query("fetch_outcomes", """SELECT 's' || user_id % 5 AS source, count(*) AS attempted, count(*) FILTER (event_type = 'view') AS extracted,
  count(*) FILTER (event_type = 'click') AS empty, count(*) FILTER (event_type = 'error') AS blocked FROM events GROUP BY 1""")
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    outcome = F.when(kind == "view", "extracted").when(kind == "click", "empty").when(kind == "error", "blocked")
    source = F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string"))
    return Q.fetch_outcomes(B.table(spark, sf_dir, "events").select(source.alias("source"), outcome.alias("outcome")))


@query("freshness", f"""WITH p AS ({points_sql('day')}), c AS (SELECT count(*) AS specs, max(t) AS b FROM p)
SELECT specs, 'ok' AS index, CAST(epoch(TIMESTAMP '2024-01-30 05:00:00' - b) AS BIGINT) AS age_seconds, CASE WHEN epoch(TIMESTAMP '2024-01-30 05:00:00' - b) > 21600 THEN 'stale' ELSE 'ok' END AS freshness,
  epoch(TIMESTAMP '2024-01-30 05:00:00' - b) <= 21600 AS ready FROM c""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.freshness(medians_by(spark, sf_dir, "day"), F.col("t"), _ts("2024-01-30 05:00:00"))


@query("age_labels", """SELECT event_id, CASE WHEN s < 3600 THEN 'کمتر از یک ساعت پیش' WHEN s < 86400 THEN CAST((s + 1800) // 3600 AS VARCHAR) || ' ساعت پیش'
  ELSE CAST((s + 43200) // 86400 AS VARCHAR) || ' روز پیش' END AS label FROM (SELECT event_id, epoch_ms(TIMESTAMP '2024-02-01') // 1000 - CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM events)""")
def age_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "events").select("event_id", age_label(F.col("ts"), _ts("2024-02-01")).alias("label"))


# --- sessions and overlapping windows -------------------------------------------


@query("session_windows", """WITH m AS (SELECT user_id, ts, CAST(round(value * 100) AS BIGINT) AS cents, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM m)
SELECT user_id, min(ts)::TIMESTAMP AS session_start, (max(ts) + INTERVAL 6 HOUR)::TIMESTAMP AS session_end, count(*) AS events, CAST(sum(cents) AS BIGINT) AS cents FROM n GROUP BY user_id, session""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = W.sessions(B.table(spark, sf_dir, "events"), ["user_id"], "ts", 6 * 3600, cents=F.round(F.col("value") * 100).cast("bigint"))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("sliding_windows", """SELECT event_type, to_timestamp((floor(epoch(ts) / 900) - k) * 900)::TIMESTAMP AS window_start, count(*) AS events, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
FROM events, range(4) t(k) GROUP BY 1, 2""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that begin every quarter of an hour."""
    found = W.sliding(B.table(spark, sf_dir, "events"), ["event_type"], "ts", 3600, 900, cents=F.round(F.col("value") * 100).cast("bigint"))
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# --- accounts -------------------------------------------------------------------


@query("mailable_export", f"""WITH {USERS}, {SUBSCRIBERS} SELECT CASE WHEN regexp_matches(email, '^[=+\\-@\\t\\r]') THEN '''' || email ELSE email END AS email,
  CASE WHEN regexp_matches(source, '^[=+\\-@\\t\\r]') THEN '''' || source ELSE source END AS source, strftime(confirmed_at, '%Y-%m-%dT%H:%M:%SZ') AS confirmed_at
FROM subscribers WHERE confirmed_at IS NOT NULL AND unsubscribed_at IS NULL""")
def mailable_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mailable_export(_subscribers(spark, sf_dir))


@query("dashboard_counts", f"""WITH {USERS}, {SUBSCRIBERS} SELECT (SELECT count(*) FROM users) AS users, (SELECT count(verified_at) FROM users) AS verified, (SELECT count(*) FROM orders) AS saved_searches,
  (SELECT count(*) FROM events WHERE event_type <> 'error' AND ts > TIMESTAMP '2024-01-15') AS active_sessions, (SELECT count(*) FROM conversations WHERE role <> 'assistant') AS unread_contact,
  (SELECT count(*) FROM subscribers) AS subscribers, (SELECT count(*) FROM subscribers WHERE confirmed_at IS NOT NULL AND unsubscribed_at IS NULL) AS subscribers_confirmed,
  (SELECT count(*) FROM users WHERE marketing_consent) AS marketing_optin""")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = B.table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", F.col("ts")).alias("revoked_at"), F.col("ts").alias("expires_at"))
    messages = B.table(spark, sf_dir, "conversations").select(F.when(F.col("role") == "assistant", F.col("turn")).alias("handled_at"))
    return A.dashboard(_users(spark, sf_dir), _saved_searches(spark, sf_dir), sessions, messages, _subscribers(spark, sf_dir), _ts("2024-01-15"))


@query("paged_listing", "SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.page_of(B.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 25, 50)


@query("subscriber_backfill", f"""WITH {USERS}, {SUBSCRIBERS} SELECT email, source, confirmed_at, unsubscribed_at FROM subscribers
UNION ALL SELECT email, 'register', created_at, NULL FROM users WHERE marketing_consent AND email NOT IN (SELECT email FROM subscribers)""")
def subscriber_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.backfill_subscribers(_users(spark, sf_dir), _subscribers(spark, sf_dir))


@query("signup_labels", r"""WITH t AS (SELECT page_id, trim(regexp_replace(nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ''), '\s+', ' ', 'g')) AS t FROM pages)
SELECT page_id, CASE WHEN t IS NULL OR length(t) = 0 OR length(t) > 40 OR regexp_matches(t, '[\p{Cc}\p{Cf}\p{Zl}\p{Zp}\x{a0}]') THEN 'landing' ELSE t END AS label FROM t""")
def signup_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "pages").select("page_id", clamp_label(page_title(F.col("html"))).alias("label"))


def consent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as consent actions of one address per user."""
    kind = F.col("event_type")
    action = F.when(kind.isin("view", "signup"), "subscribe").when(kind == "click", "confirm").when(kind == "purchase", "unsubscribe").otherwise("add_confirmed")
    return B.table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("email"), F.col("ts").cast("timestamp").alias("at"), action.alias("action"), F.lit("landing").alias("source")
    )


CONSENT = f"""WITH RECURSIVE e AS (SELECT 'u' || user_id AS email, ts AS moment, action, row_number() OVER (PARTITION BY user_id ORDER BY ts, action) AS n FROM (SELECT *, CASE WHEN event_type IN ('view', 'signup') THEN 'subscribe'
  WHEN event_type = 'click' THEN 'confirm' WHEN event_type = 'purchase' THEN 'unsubscribe' ELSE 'add_confirmed' END AS action FROM events)),
st(email, n, held, c, u, l, s) AS (SELECT DISTINCT email, 0::BIGINT, false, NULL::TIMESTAMP, NULL::TIMESTAMP, NULL::TIMESTAMP, 0 FROM e UNION ALL
  SELECT email, n, held OR coalesce(k IN ('sub', 'new'), false), CASE WHEN k = 'sub' THEN NULL WHEN k IN ('new', 'add', 'confirm') THEN moment ELSE c END,
    CASE WHEN k IN ('sub', 'new') THEN NULL WHEN k = 'leave' THEN moment ELSE u END, CASE WHEN k = 'sub' THEN moment WHEN k = 'new' THEN NULL ELSE l END,
    CASE WHEN k = 'sub' THEN s + 1 WHEN k IN ('new', 'add') THEN 0 ELSE s END
  FROM (SELECT st.email, e.n, held, c, u, l, s, moment, CASE
      WHEN action = 'subscribe' AND (NOT held OR (s < {A.MAX_UNANSWERED} AND ((c IS NOT NULL AND u IS NOT NULL) OR (c IS NULL AND u IS NULL AND (l IS NULL OR epoch(moment) - epoch(l) > {A.RESEND_SECONDS}))))) THEN 'sub'
      WHEN action = 'add_confirmed' AND NOT held THEN 'new' WHEN action = 'add_confirmed' AND c IS NULL AND u IS NULL THEN 'add'
      WHEN held AND action = 'confirm' AND u IS NULL AND c IS NULL THEN 'confirm' WHEN held AND action = 'unsubscribe' AND u IS NULL THEN 'leave' END AS k
    FROM st JOIN e ON e.email = st.email AND e.n = st.n + 1))
SELECT email, 'landing' AS source, c AS confirmed_at, u AS unsubscribed_at, l AS last_sent_at, CAST(s AS INTEGER) AS sends FROM st WHERE held QUALIFY row_number() OVER (PARTITION BY email ORDER BY n DESC) = 1"""


def _naive(ledger: DataFrame) -> DataFrame:
    return ledger.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("confirmed_at", "unsubscribed_at", "last_sent_at")})


@query("consent_ledger", CONSENT)
def consent_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(A.consent_ledger(consent_events(spark, sf_dir)))
