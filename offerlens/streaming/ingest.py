"""Continuous capture: first-seen content, latest listing, request rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from offerlens.operators.cards import latest_captures
from offerlens.operators.quality import rate_windows


def parquet_stream(spark: SparkSession, folder: str, name: str, schema: str | StructType, files_per_batch: int | None = 64) -> DataFrame:
    """A folder's files matching ``name`` as a stream, oldest first.

    At most ``files_per_batch`` files make one micro-batch: that bounds the rows a keyed
    state machine puts in order at once, however long the backlog is. With None a micro-batch
    takes all files there are: for a feed that is written span by span.
    """
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", True)
    return (source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source).parquet(folder)


def first_seen(stream: DataFrame, ts: str, delay: str, keys: Sequence[str] = ("source", "source_id", "content_hash")) -> DataFrame:
    """Captures whose content was not seen within the delay; state ages out with it."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def request_windows(stream: DataFrame, keys: Sequence[str], ts: str, limit: int, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Requests per key and tumbling window; a window closes when the watermark passes it."""
    return rate_windows(stream.withWatermark(ts, delay), keys, ts, window, limit)


def session_stream(stream: DataFrame, keys: Sequence[str], ts: str, gap: str, delay: str) -> DataFrame:
    """Sessions of a key that end ``gap`` after their last event.

    Partial sessions are merged in the state until the watermark passes their end; a late
    event within the delay can still join two of them.
    """
    session = F.session_window(F.col(ts), gap)
    counted = stream.withWatermark(ts, delay).groupBy(session.alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def sliding_stream(stream: DataFrame, keys: Sequence[str], ts: str, size: str, slide: str, delay: str) -> DataFrame:
    """Events per key and overlapping window; windows close when the watermark passes them."""
    counted = stream.withWatermark(ts, delay).groupBy(F.window(F.col(ts), size, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(*keys, F.col("w.start").alias("window_start"), "events")


def write_batches(stream: DataFrame, path: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Write each micro-batch to its own folder.

    A batch that is retried after a failure overwrites its own folder, so every
    batch lands exactly once.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer).start()


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches written so far, with their ``batch_id``."""
    return spark.read.schema(f"{schema}, batch_id bigint").parquet(f"{path}/rows")


def upsert_latest(
    stream: DataFrame, path: str, order: Sequence[Column], keys: Sequence[str] = ("source_id", "source"), buckets: int = 32, once: bool = True
) -> StreamingQuery:
    """Keep the newest capture per listing in a table of ``buckets`` parts by key.

    A batch reads and rewrites only the parts that its own keys fall into, each as one file,
    so reading the current state never grows with the number of batches. A batch that is
    retried finds its rows in place and writes the same parts again. Choose the number of
    parts so that one of them is a task's work.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.hash(*keys), F.lit(buckets)).alias("_part")
        fresh = latest_captures(batch, order, keys).select("*", part)
        touched = [r["_part"] for r in fresh.select("_part").distinct().collect()]
        if not touched:
            return
        held = _held(spark, path, fresh.schema)
        merged = fresh if held is None else latest_captures(held.where(F.col("_part").isin(touched)).select(*fresh.columns).unionByName(fresh), order, keys)
        writer = merged.repartition(buckets, "_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("_part").parquet(f"{path}/rows")

    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _held(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return None
    return spark.read.schema(schema).parquet(f"{path}/rows")


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest capture of every listing, as the last finished batch left them."""
    return spark.read.schema(f"{schema}, _part int").parquet(f"{path}/rows").drop("_part")
