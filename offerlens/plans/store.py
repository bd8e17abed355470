"""Tables written between the steps of a job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from offerlens.plans.session import shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read, and read it back.

    The copy lives in the shared folder, so it survives a lost executor and gives
    the following steps file statistics and column pruning. Each call has its own
    folder: a half-written copy is never read, and a retry cannot meet an old one.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one; nothing is written yet."""
    return f"{shared_dir(spark)}/offerlens/{name}-{uuid.uuid4().hex}"


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Write a table dealt and sorted by its keys, and read it back.

    A lookup by key reads the one bucket that can hold it, and tables of equal keys and
    buckets join without an exchange. The files lie in the shared folder; the session's
    catalog knows them under a name of their own.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    label = f"offerlens_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys)
    writer.option("path", new_folder(spark, name)).saveAsTable(label)
    return spark.table(label)
