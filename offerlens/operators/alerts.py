"""Price alerts over runs of saved searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.operators.sequences import thin_by_gap

REPEAT_DAYS, BATCH = 7, 200
PCT_RANGE = (1, 90)


def percent_change(old: Column, new: Column) -> Column:
    """Signed change; 0 when there is no old value."""
    return F.when(old == 0, F.lit(0.0)).otherwise((new - old) * 100.0 / F.when(old != 0, old))


def due_searches(saved: DataFrame, users: DataFrame, most: int = BATCH) -> DataFrame:
    """Watched searches of verified users, never-run ones first."""
    verified = users.where(F.col("verified_at").isNotNull()).select("user_id", "email")
    watched = saved.where(F.col("alert_pct").isNotNull()).join(verified, "user_id")
    return watched.orderBy(F.asc_nulls_first("last_run_at"), "id").limit(most)


def armed(saved: DataFrame, users: DataFrame) -> DataFrame:
    """Searches with the verdict on their alert: accepted, none, unverified or out_of_range.

    A threshold must lie in ``PCT_RANGE`` and the address must be verified; a search
    without a threshold asks for no alert.
    """
    verified = users.select("user_id", F.col("verified_at").isNotNull().alias("_ok"))
    verdict = (
        F.when(F.col("alert_pct").isNull(), "none").when(~F.coalesce("_ok", F.lit(False)), "unverified")
        .when(~F.col("alert_pct").between(*PCT_RANGE), "out_of_range").otherwise("accepted")
    )
    return saved.join(verified, "user_id", "left").withColumn("verdict", verdict).drop("_ok")


def candidates(runs: DataFrame, search: str = "search_id", ts: str = "run_at") -> DataFrame:
    """Runs whose quoted median moved by the search's threshold since the last quoted run.

    A run with an unquoted median neither alerts nor moves the baseline; the first
    quoted run only sets it. A search has one row per run.
    """
    quoted = runs.where(F.col("reliable"))
    w = Window.partitionBy(search).orderBy(ts)
    moved = quoted.withColumn("old_median", F.lag("median").over(w)).withColumnRenamed("median", "new_median")
    pct = percent_change(F.col("old_median"), F.col("new_median"))
    moved = moved.where(F.col("old_median") > 0).withColumn("pct", pct)
    return moved.where(F.abs("pct") >= F.col("alert_pct"))


def not_recently_sent(found: DataFrame, sent: DataFrame, ts: str = "run_at", days: int = REPEAT_DAYS) -> DataFrame:
    """Without movements already mailed in the last days (time-bounded anti join)."""
    past = sent.select(
        F.col("search_id").alias("_s"), F.col("spec_key").alias("_k"), F.col("new_median").alias("_m"), F.col("sent_at").alias("_at")
    )
    same = (F.col("search_id") == F.col("_s")) & (F.col("spec_key") == F.col("_k")) & (F.col("new_median") == F.col("_m"))
    recent = (F.col("_at") <= F.col(ts)) & (F.col("_at") > F.timestamp_add("DAY", F.lit(-days), F.col(ts)))
    return found.join(past, same & recent, "left_anti")


def price_alerts(runs: DataFrame, search: str = "search_id", ts: str = "run_at", days: int = REPEAT_DAYS) -> DataFrame:
    """Alerts a whole log of runs would have sent, repeats left out."""
    return thin_by_gap(candidates(runs, search, ts), [search, "spec_key", "new_median"], ts, days * 86400)
