"""Published forms of cards and lists."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.operators.cards import ranked_cards


def _files(spark: SparkSession, path: str):
    """Spark's own file system for a path, and the path as it wants it."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def _manifests(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers of the manifests, oldest first."""
    fs, place = _files(spark, f"{root}/{name}/manifests")
    if not fs.exists(place):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(place)]
    return sorted(int(n) for n in names if n.isdigit())


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless there is one already; only one of two writers succeeds."""
    fs, place = _files(spark, path)
    fs.mkdirs(place.getParent())
    try:
        out = fs.create(place, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _version(spark: SparkSession, root: str, name: str, number: int) -> str | None:
    """The version a manifest names; None while its writer has not finished it."""
    fs, place = _files(spark, f"{root}/{name}/manifests/{number:012d}")
    if not fs.exists(place):
        return None
    text = spark.read.text(place.toString()).first()
    return text["value"].removeprefix("version ").rstrip(".") if text and text["value"].endswith(".") else None


def publish(df: DataFrame, root: str, name: str, keep: int = 3) -> int:
    """Write a new version of a table, then name it in the next manifest; returns its number.

    Readers follow the newest whole manifest, so they see an old version or the whole new
    one. A manifest is made only if its number is free: of two writers one gets the number
    and the other takes the next, so both land and neither hides the other's. The newest
    ``keep`` versions stay for readers that began before; older ones are removed.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.parquet(f"{root}/{name}/versions/{version}")
    number = (_manifests(spark, root, name) or [0])[-1] + 1
    while not _create(spark, f"{root}/{name}/manifests/{number:012d}", f"version {version}."):
        number += 1
    retire(spark, root, name, keep)
    return number


def retire(spark: SparkSession, root: str, name: str, keep: int = 3) -> None:
    """Remove all but the newest ``keep`` versions: the manifest first, then its data."""
    for number in _manifests(spark, root, name)[: -max(1, keep)]:
        version = _version(spark, root, name, number)
        for path in (f"{root}/{name}/manifests/{number:012d}", f"{root}/{name}/versions/{version}" if version else None):
            if path:
                fs, place = _files(spark, path)
                fs.delete(place, True)


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The newest published version."""
    for number in reversed(_manifests(spark, root, name)):
        version = _version(spark, root, name, number)
        if version is not None:
            return spark.read.parquet(f"{root}/{name}/versions/{version}")
    raise ValueError(f"nothing is published as {name}")


def url_list(cards: DataFrame, base: str, key: str = "spec_key") -> DataFrame:
    """Card addresses for search engines with their 0-based ``place``, best corroborated first."""
    priority = F.when(F.col("source_count") > 1, "0.8").otherwise("0.4")
    listed = ranked_cards(cards, key).orderBy("position")
    return listed.select(F.col("position").alias("place"), F.concat(F.lit(f"{base}/car/"), F.col(key)).alias("loc"), priority.alias("priority"))


def url_entries(urls: DataFrame) -> DataFrame:
    """One XML entry per address, ready for ``write.text``."""
    escaped = F.replace(F.replace(F.replace(F.col("loc"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    entry = F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc><changefreq>daily</changefreq><priority>"), F.col("priority"), F.lit("</priority></url>"))
    return urls.select(entry.alias("value"))


def structured_offer(name: Column, brand: Column, model: Column, year: Column, low: Column, high: Column, count: Column, image: Column, divisor: int = 10) -> Column:
    """A card as a schema.org record, prices back in the unit the currency names."""
    typed = lambda t, **kv: F.struct(F.lit(t).alias("@type"), *[v.alias(k) for k, v in kv.items()])
    record = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Car").alias("@type"), name.alias("name"),
        typed("Brand", name=brand).alias("brand"), model.alias("model"), year.cast("string").alias("productionDate"), image.alias("image"),
        typed("AggregateOffer", priceCurrency=F.lit("IRR"), lowPrice=low * divisor, highPrice=high * divisor, offerCount=count).alias("offers"),
    )
    return F.to_json(record)


def live_sources(sources: DataFrame, facts: DataFrame) -> DataFrame:
    """Sources in the index with their static facts; unknown ones are dropped."""
    return sources.select("source").distinct().join(facts, "source")
