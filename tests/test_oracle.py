"""Every registered query against its SQL at the smallest scale, and its plan."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry

# Queries of the optional text operators are tested with these operators, against SQL or
# plain Python.
QUERIES = {name: run for name, run in entry.queries().items() if entry.llm is None or name not in entry.llm.QUERIES}
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, sf_dir, name):
    problem, _ = difference(spark, duck, QUERIES[name], ORACLES[name], sf_dir)
    assert problem is None


def test_entry_returns_cards(spark):
    df = entry.entry(spark)
    assert {"spec_key", "median_price", "median_reliable"} <= set(df.columns)
    assert df.count() > 0


def test_streamed_consent_equals_batch(spark, sf_dir):
    batch = {tuple(r) for r in QUERIES["consent_ledger"](spark, sf_dir).collect()}
    stream = {tuple(r) for r in QUERIES["stream_consent"](spark, sf_dir).collect()}
    assert batch == stream
