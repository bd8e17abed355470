"""Grouped primitives against brute force, with one key holding most rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from offerlens.operators import scale as S


def skewed(n=3000, seed=1, hi=5_000_000):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(40)}", rnd.randrange(1, hi) if rnd.random() < 0.8 else 777, i) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return skewed()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, v bigint, id bigint").repartition(5).cache()


@pytest.mark.parametrize("shifts", [(20, 0), (40, 20, 0), (10, 5, 0), (0,)])
def test_order_statistics(df, rows, shifts):
    ranks = {"lo": lambda n: F.lit(1), "p95": lambda n: F.least(n - 1, F.floor(n * 95 / 100)) + 1, "hi": lambda n: n}
    got = {r.k: (r.n, r.lo, r.p95, r.hi) for r in S.order_statistics(df, ["k"], "v", ranks, shifts=shifts).collect()}
    for key in {k for k, _, _ in rows}:
        v = sorted(x for k, x, _ in rows if k == key)
        n = len(v)
        assert got[key] == (n, v[0], v[min(n - 1, n * 95 // 100)], v[-1])


def test_median_floors_the_mean_of_two(df, rows):
    got = {r.k: r.median for r in S.exact_median(df, ["k"], "v").collect()}
    for key in {k for k, _, _ in rows}:
        assert got[key] == int(statistics.median(x for k, x, _ in rows if k == key))


def test_median_reads_weights(spark):
    ladder = spark.createDataFrame([("a", 10, 3), ("a", 20, 2), ("b", 1 << 35, 2), ("b", 5, 2)], "k string, v bigint, w bigint")
    got = {r.k: (r.n, r.median) for r in S.exact_median(ladder, ["k"], "v", "w").collect()}
    assert got == {"a": (5, 10), "b": (4, ((1 << 35) + 5) // 2)}


def test_positions(df, rows):
    keyed = df.withColumn("band", F.shiftright("v", 20)).withColumn("h", F.md5(F.col("id").cast("string"))).withColumn("cell", F.left("h", F.lit(2)))
    got = {r.id: r.position for r in S.positions(keyed, ["k"], ["band", "v", "cell"], ["h"]).collect()}
    import hashlib

    for key in {k for k, _, _ in rows}:
        order = sorted((v, hashlib.md5(str(i).encode()).hexdigest(), i) for k, v, i in rows if k == key)
        assert [got[i] for _, _, i in order] == list(range(len(order)))


def test_top_per_group_limits_before_the_shuffle(df):
    plan = S.top_per_group(df, ["k"], [F.asc("v"), F.asc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_dealt_rows_stay_dealt(spark, sf_dir):
    """Costly per-row work runs in as many tasks as the session has shuffle partitions."""
    from offerlens.plans import bindings as B

    rows = B.dealt(B.table(spark, sf_dir, "orders"), "o_orderkey").withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in rows.groupBy("task").count().collect()]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(sizes) == n and max(sizes) < 2 * sum(sizes) / n
