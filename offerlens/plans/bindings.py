"""The operators bound to the star-schema and event tables.

Line items play the captured offers: one line is one capture, the line id is the
listing id (so repeated ids are re-captures), the part is the car.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.operators.cards import latest_captures
from offerlens.operators.flags import FlagRules, record_flags

RULES = FlagRules(current_year=2002, max_km_per_year=250_000, worked_on=("R", "N"))
MILEAGE_BAND = 250_000
FIRST_YEAR, LAST_YEAR = 1995, 2002


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key before costly per-row work.

    A stored file of one block would else be one task. The number of partitions is given, so
    adaptive execution does not merge them again. The key is the one of the next join where
    there is one, so that join needs no exchange of its own.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures, before the join that names them."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), (F.col("l_orderkey") % 5).cast("string")).alias("source"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_id"),
        F.col("l_shipdate").alias("seen_at"),
        F.year("l_shipdate").alias("year"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"),
        ((F.col("l_quantity") - 1) * 20000).cast("bigint").alias("mileage_km"),
        F.col("l_returnflag").alias("body_status"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("https://img.example/"), F.col("l_suppkey").cast("string"), F.lit(".jpg"))).alias("image"),
        "l_partkey", "l_suppkey",
    )


def newest_first() -> list[Column]:
    """A total order over the capture columns."""
    return [F.desc(c) for c in ("seen_at", "l_partkey", "l_suppkey", "price", "mileage_km", "body_status", "image")]


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per listing with its key and record findings.

    Captures collapse before the join, so only surviving rows meet the parts.
    """
    kept = latest_captures(lines(spark, sf_dir), newest_first())
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    joined = kept.join(part, F.col("l_partkey") == F.col("p_partkey"))
    bucket = F.floor(F.col("mileage_km") / MILEAGE_BAND).cast("int")
    flags = record_flags(
        RULES, F.col("mileage_km"), F.col("year"), F.col("body_status"), F.col("p_name"), F.col("price")
    )
    return joined.select(
        F.concat_ws("/", "p_brand", "p_type", F.col("year").cast("string"), bucket.cast("string")).alias("spec_key"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("model"), "year", bucket.alias("km_bucket"),
        "source", "source_id", F.col("p_name").alias("title"), "price", "mileage_km", "body_status", "image", "seen_at",
        flags.alias("flags"),
    )


DIMS = ("brand", "model", "year", "km_bucket")
