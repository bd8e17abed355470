"""Evaluation reports, freshness, usage and cost, fetch outcomes, failure runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.numbers import signed_pct
from offerlens.operators.scale import order_statistics
from offerlens.operators.sequences import running_total
from offerlens.plans.store import stored

STALE_AFTER_SECONDS = 6 * 3600
DAILY_CEILING_MICROS = 5_000_000
BREAKER_STRIKES, BREAKER_SECONDS = 3, 1800
LOCKOUT_FAILURES = 8
LOCKOUT_SECONDS = 900


def _agrees(field: str) -> Column:
    """What was got equals what was wanted; absent, 0 and empty are one."""
    zero = lambda c: F.when(c.isNull() | (c == "0"), F.lit("")).otherwise(c)
    return zero(F.col(f"got_{field}").cast("string")) == zero(F.col(f"want_{field}").cast("string"))


def evaluation_failures(cases: DataFrame, fields: Sequence[str], case: str = "case_id", error: str | None = None) -> DataFrame:
    """One row per case and pinned field that disagrees: ``field``, ``wanted``, ``got``.

    A case that ended in an error (a text in column ``error``) fails once, as field
    ``error``, whatever it would have got.
    """
    broken = F.col(error).isNotNull() if error else F.lit(False)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    wrong = [
        F.when(~broken & F.col(f"want_{f}").isNotNull() & ~_agrees(f), F.struct(F.lit(f).alias("field"), text(f"want_{f}").alias("wanted"), text(f"got_{f}").alias("got")))
        for f in fields
    ]
    if error:
        wrong.append(F.when(broken, F.struct(F.lit("error").alias("field"), F.lit("").alias("wanted"), text(error).alias("got"))))
    return cases.select(case, F.explode(F.array_compact(F.array(*wrong))).alias("w")).select(case, "w.*")


def evaluation_counts(cases: DataFrame, source: str, error: str) -> DataFrame:
    """Cases per ``source`` that gave the parse; those that ended in an error count as ``error``."""
    told = cases.select(F.when(F.col(error).isNotNull(), F.lit("error")).otherwise(F.coalesce(F.col(source), F.lit("?"))).alias("source"))
    return told.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def evaluate(cases: DataFrame, fields: Sequence[str], latency: str | None = None) -> DataFrame:
    """Accuracy over labelled cases, in long form ``(metric, n, correct, pct)``.

    ``want_<field>`` NULL means the case does not pin the field; ``got_<field>``
    NULL equals an expected 0 or empty text. A case passes when every pinned field
    agrees. Latencies are whole numbers; p50 averages the two middle values and
    p95 is the value at ``floor(0.95 n)``, both exact.
    """
    pinned = {f: F.col(f"want_{f}").isNotNull() for f in fields}
    right = {f: _agrees(f) for f in fields}
    passed = F.lit(True)
    for f in fields:
        passed = passed & (~pinned[f] | right[f])
    marks = cases.select(
        passed.alias("c_case"), *[pinned[f].alias(f"n_{f}") for f in fields], *[(pinned[f] & right[f]).alias(f"c_{f}") for f in fields],
        *([] if latency is None else [latency]),
    )
    if latency is not None:
        # Read twice below: the cases behind it are worked out once.
        marks = stored(marks, "eval-marks")
    counts = marks.agg(F.count(F.lit(1)).alias("n_case"), *[F.count_if(c).alias(c) for c in marks.columns if c != latency])
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"n_{m}").alias("n"), F.col(f"c_{m}").alias("correct")) for m in ("case", *fields)
    ])
    report = counts.select(F.explode(rows).alias("r")).select("r.*")
    report = report.withColumn("pct", signed_pct(F.col("correct"), F.col("n")))
    if latency is None:
        return report
    ranks = {"lo": lambda n: F.floor((n + 1) / 2), "hi": lambda n: F.floor(n / 2) + 1, "p95": lambda n: F.least(n - 1, F.floor(n * 95 / 100)) + 1}
    at = order_statistics(marks.select(latency, F.lit(1).alias("_all")), ["_all"], latency, ranks)
    values = F.array(
        F.struct(F.lit("latency_p50").alias("metric"), ((F.col("lo") + F.col("hi")) / 2).alias("pct")),
        F.struct(F.lit("latency_p95").alias("metric"), F.col("p95").cast("double").alias("pct")),
    )
    tail = at.select("n", F.explode(values).alias("r")).select("r.metric", "n", F.lit(None).cast("bigint").alias("correct"), "r.pct")
    return report.unionByName(tail)


def freshness(card_rows: DataFrame, built_at: Column, now: Column) -> DataFrame:
    """One row that says whether the index can be served and which check failed."""
    counted = card_rows.agg(F.count(F.lit(1)).alias("specs"), F.max(built_at).alias("built_at"))
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("built_at").cast("timestamp"))
    index = F.when(F.col("specs") == 0, "empty").otherwise("ok")
    fresh = F.when(F.col("built_at").isNull(), "unknown build time").when(age > STALE_AFTER_SECONDS, "stale").otherwise("ok")
    ok = (index == "ok") & (fresh == "ok")
    return counted.select("specs", index.alias("index"), age.alias("age_seconds"), fresh.alias("freshness"), ok.alias("ready"))


def priced(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Cost in millionths of a dollar; an unknown model costs nothing.

    Dollars per million tokens are millionths of a dollar per token, and whole
    numbers sum the same way in any order.
    """
    rate = rates.select("model", "rate_in", "rate_out")
    cost = F.round(F.col("tokens_in") * F.coalesce("rate_in", F.lit(0.0)) + F.col("tokens_out") * F.coalesce("rate_out", F.lit(0.0)))
    return usage.join(rate, "model", "left").withColumn("cost_micros", cost.cast("bigint")).drop("rate_in", "rate_out")


def usage_rollup(usage: DataFrame, ts: str = "ts") -> DataFrame:
    """Per day: spend, calls, cache hits, rejections, fallbacks."""
    return usage.groupBy(F.to_date(ts).alias("day")).agg(
        F.sum("cost_micros").alias("spend_micros"), F.count_if(F.col("outcome") == "call").alias("calls"),
        F.count_if(F.col("outcome") == "cache_hit").alias("cache_hits"),
        F.count_if(F.col("outcome") == "rejected").alias("rejections"),
        F.count_if(F.col("outcome") == "fallback").alias("fallbacks"),
    )


def budget_cutoff(calls: DataFrame, ts: str, tiebreak: Sequence[str], cost: str = "cost_micros", ceiling: int = DAILY_CEILING_MICROS) -> DataFrame:
    """Whether each call still fell under the day's ceiling when it was made."""
    daily = calls.withColumn("_day", F.to_date(ts))
    spent = running_total(daily, ["_day"], ts, tiebreak, F.col(cost), "spent_before", inclusive=False)
    return spent.withColumn("allowed", F.col("spent_before") < ceiling).drop("_day")


def failure_runs(log: DataFrame, key: str, ts: str, tiebreak: Sequence[str], failed: Column) -> DataFrame:
    """Add ``strikes``: failures in a row up to each row, 0 at a success."""
    fail = F.coalesce(failed, F.lit(False))
    return running_total(log, [key], ts, tiebreak, fail.cast("int"), "strikes", reset=~fail)


def breaker_openings(log: DataFrame, key: str, ts: str, tiebreak: Sequence[str], failed: Column, strikes: int = BREAKER_STRIKES, seconds: int = BREAKER_SECONDS) -> DataFrame:
    """Moments at which a host's breaker opened and until when."""
    runs = failure_runs(log, key, ts, tiebreak, failed)
    opened = runs.where((F.col("strikes") > 0) & (F.col("strikes") % strikes == 0))
    until = F.timestamp_add("SECOND", F.lit(seconds), F.col(ts))
    return opened.withColumn("open_until", until)


def lockouts(log: DataFrame, key: str, ts: str, tiebreak: Sequence[str], failed: Column, threshold: int = LOCKOUT_FAILURES, seconds: int = LOCKOUT_SECONDS) -> DataFrame:
    """Failed attempts at or past the threshold since the last success, each with the time
    until which it locks the account."""
    found = failure_runs(log, key, ts, tiebreak, failed).where(F.col("strikes") >= threshold)
    return found.withColumn("locked_until", F.timestamp_add("SECOND", F.lit(seconds), F.col(ts)))


def counts_by(rows: DataFrame, column: str, missing: str = "?") -> DataFrame:
    """Rows per value of a column; rows without one are counted under ``missing``."""
    return rows.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def fetch_outcomes(attempts: DataFrame, source: str = "source", outcome: str = "outcome") -> DataFrame:
    """Outcome counts per source as columns."""
    kinds = ["extracted", "empty", "blocked"]
    counts = attempts.groupBy(source).agg(
        F.count(F.lit(1)).alias("attempted"), *[F.count_if(F.col(outcome) == k).alias(k) for k in kinds]
    )
    return counts


def rate_windows(requests: DataFrame, keys: Sequence[str], ts: str, window: str, limit: int) -> DataFrame:
    """Requests per key and tumbling window, with the number over the limit."""
    counted = requests.groupBy(F.window(F.col(ts).cast("timestamp"), window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("requests"))
    over = F.greatest(F.col("requests") - limit, F.lit(0))
    return counted.select(F.col("w.start").alias("window_start"), *keys, "requests", over.cast("bigint").alias("over"))
