"""Summaries of the tiers in force, against joining them all."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pricewatch_spark.operators import history

T0 = dt.datetime(2026, 1, 1)


@pytest.mark.parametrize("step", [dt.timedelta(days=1), dt.timedelta(minutes=1), dt.timedelta(microseconds=7)])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_the_summary_equals_the_joined_tiers(spark, step, kind):
    r = random.Random(5)
    tiers = []
    for k in range(300):
        start = T0 + r.randrange(-60, 120) * step + r.choice([0, 0, 1]) * dt.timedelta(microseconds=3)
        tiers.append((r.choice(["a", "b", None]), f"t{k}", r.choice([None, 1.5, 2.25, float(k)]), start if k % 40 else None, None if k % 9 == 0 else start + r.randrange(-1, 40) * step))
    points = [(k, r.choice(["a", "b", "c", None]), None if k % 50 == 0 else T0 + r.randrange(100) * step) for k in range(200)]
    offers = spark.createDataFrame(tiers, f"market string, tier_name string, price double, valid_from {kind}, valid_to {kind}").withColumn("price", F.col("price").cast("decimal(12,2)"))
    asked = spark.createDataFrame(points, f"id long, market string, at {kind}")
    joined = history.tiers_as_of(offers, asked, "market").groupBy("id").agg(F.count(F.lit(1)).alias("tiers"), F.min("price").alias("cheapest"), F.max("valid_from").alias("newest"))
    expected = sorted(map(tuple, joined.collect()))
    got = sorted(tuple(x) for x in history.tiers_summary(offers, asked, "market").select("id", "tiers", "cheapest", "newest").collect())
    assert got == expected and len(got) > 80


def test_nothing_in_nothing_out(spark):
    offers = spark.createDataFrame([], "market string, tier_name string, price decimal(12,2), valid_from timestamp, valid_to timestamp")
    some = spark.createDataFrame([(1, "a", T0)], "id long, market string, at timestamp")
    assert history.tiers_summary(offers, some, "market").isEmpty() and history.tiers_summary(offers, some.limit(0), "market").isEmpty()


def test_one_market_whose_tiers_are_all_in_force(spark):
    """4 * 10^10 pairs of a tier and a point."""
    n = 200_000
    offers = spark.range(n).selectExpr("1 AS market", "'t' AS tier_name", "CAST(1 + id AS DECIMAL(12,2)) AS price", "TIMESTAMP '2025-01-01' + make_dt_interval(0, 0, 0, id) AS valid_from", "CAST(NULL AS TIMESTAMP) AS valid_to")
    asked = spark.range(n).selectExpr("id", "1 AS market", "TIMESTAMP '2026-01-01' + make_dt_interval(0, 0, 0, id) AS at")
    got = history.tiers_summary(offers, asked, "market").agg(F.count(F.lit(1)), F.min("tiers"), F.max("tiers"), F.max("cheapest"), F.min("newest")).first()
    assert tuple(got) == (n, n, n, 1, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=n - 1))
