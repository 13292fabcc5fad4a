"""Periods by batches, tiers by bins, sketches, brands by joins, JDBC ranges, repeated runs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pricewatch_spark.functions import titles
from pricewatch_spark.operators import history, periods, scoring
from pricewatch_spark.operators.delta import state_periods
from pricewatch_spark.sources import tables

HOW = (["k"], ["s"], "at", "n")
POINTS = "k string, s string, at timestamp, n int"
START = dt.datetime(2026, 1, 1)


def points(spark, rows):
    return spark.createDataFrame([(k, s, None if h is None else START + dt.timedelta(hours=h), n) for k, s, h, n in rows], POINTS)


def told(*dfs):
    return sorted((tuple(r) for df in dfs for r in df.select("k", "period", "s", "valid_from", "valid_to", "points").collect()), key=repr)


def step(spark, closed, open_, batch, so_far):
    return tuple(map(tables.reliable, periods.catch_up(closed, periods.advance(open_, points(spark, batch), *HOW), points(spark, so_far), *HOW)))


def test_batches_equal_the_whole_history(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", "c", None]), r.choice(["x", "y", None]), h, h) for h in range(60)]
    rows[50] = (rows[50][0], "x", 2.5, 50)  # late
    rows[55] = ("a", "y", None, 55)  # without a time
    batches = [rows[:20], [], rows[20:21], rows[21:58], rows[58:]]
    open_ = periods.no_periods(points(spark, []), *HOW)
    closed, seen = open_, []
    for batch in batches:
        seen = seen + batch
        closed, open_ = step(spark, closed, open_, batch, seen)
        assert open_.where("valid_to is not null").count() == 0 == closed.where("valid_to is null").count()
        assert told(closed, open_) == told(state_periods(points(spark, seen), *HOW))


def test_a_batch_adds_to_closed_periods_only_what_it_ends(spark):
    first = periods.advance(periods.no_periods(points(spark, []), *HOW), points(spark, [("a", "x", 0, 0), ("b", "x", 0, 0), ("c", "x", 5, 0)]), *HOW)
    second = periods.advance(first.open, points(spark, [("a", "x", 1, 0), ("b", "y", 1, 0), ("b", "y", 2, 0), ("c", "y", 4, 0)]), *HOW)
    at = lambda h: START + dt.timedelta(hours=h)
    assert told(first.closed) == [] and told(second.closed) == [("b", 1, "x", at(0), at(1), 1)]
    # the late key keeps its old period until it is told anew
    assert told(second.open) == sorted([("a", 1, "x", at(0), None, 2), ("b", 2, "y", at(1), None, 2), ("c", 1, "x", at(5), None, 1)], key=repr)
    assert [r.k for r in second.late.collect()] == ["c"]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_tiers_equal_brute_force(spark, kind):
    r = random.Random(5)
    us = lambda: r.choice([0, 1, 3, 10**3, 10**6, 3600 * 10**6, 10**10, 10**12])
    base = lambda: START + dt.timedelta(microseconds=r.randrange(10**12) - 5 * 10**11)
    tiers = []
    for i in range(300):
        since = base() if i % 17 else None
        tiers.append((r.choice(["p", "q", None]), f"t{i}", i, since, None if i % 9 == 0 else (since or START) + dt.timedelta(microseconds=us())))
    asked = [(j, r.choice(["p", "q", "z", None]), base()) for j in range(100)]
    asked += [(100 + i, t[0], t[4] if i % 2 else t[3]) for i, t in enumerate(tiers)]
    asked += [(500 + i, t[0], t[4] - dt.timedelta(microseconds=1)) for i, t in enumerate(tiers) if t[4]]
    expected = sorted((j, t[1]) for j, k, at in asked for t in tiers if k is not None and k == t[0] and at and t[3] and t[3] <= at and (t[4] is None or at < t[4]))
    own = spark.createDataFrame(tiers, f"c string, tier_name string, price int, valid_from {kind}, valid_to {kind}")
    found = history.tiers_as_of(own, spark.createDataFrame(asked, f"j int, c string, at {kind}"), "c")
    assert found.columns == ["j", "c", "at", "tier_name", "price", "valid_from"]
    assert sorted((x.j, x.tier_name) for x in found.collect()) == expected and len(expected) > 1000
    assert history.tiers_as_of(own.limit(0), spark.createDataFrame(asked, f"j int, c string, at {kind}"), "c").count() == 0
    assert history.tiers_as_of(own, spark.createDataFrame([], f"j int, c string, at {kind}"), "c").count() == 0


def test_a_key_with_very_many_tiers(spark):
    """100,000 tiers and as many points of one key: the join on the key alone would make 10^10 pairs."""
    tiers = spark.range(100_000).selectExpr("1L AS c", "concat('t', id) AS tier_name", "1 AS price", "timestamp_seconds(id * 60) AS valid_from", "timestamp_seconds(id * 60 + 60) AS valid_to")
    asked = spark.range(100_000).selectExpr("id", "1L AS c", "timestamp_seconds(id * 60 + 30) AS at")
    found = history.tiers_as_of(tiers, asked, "c")
    assert found.where("tier_name = concat('t', id)").count() == 100_000 == found.count()


def test_sketches_merge_in_any_grouping(spark):
    raw = spark.range(60_000).selectExpr("id % 3 AS source", "id % 50 AS day", "CASE WHEN id % 5 > 0 THEN concat('v', id % 20000) ELSE '' END AS vendor", "1.0 AS price", "'' AS image_url")
    whole = scoring.summary_of_sketches(scoring.catalog_sketches(raw, ["source"], ["vendor"]), ["vendor"]).first()
    daily = scoring.summary_of_sketches(scoring.catalog_sketches(raw, ["source", "day"], ["vendor"]), ["vendor"]).first()
    assert whole == daily and whole["items"] == whole.with_price == 60_000 and whole.with_image == 0
    assert abs(whole.vendor - 16_000) < 16_000 * 3 * 1.04 / 64
    nothing = scoring.catalog_sketches(raw.withColumn("vendor", F.lit(None).cast("string")), ["day"], ["vendor"])
    assert scoring.summary_of_sketches(nothing, ["vendor"]).first().vendor == 0


def test_brands_by_joins_equal_brands_by_branches(spark):
    table = titles.brand_table(spark.createDataFrame(list(enumerate(titles.K.BRANDS)), "place int, brand string"), place="place")
    names = [b for b in titles.K.BRANDS] + [f"Eau {b} for men 100 ml" for b in titles.K.BRANDS] + [f"x{b}" for b in titles.K.BRANDS] + [f"{b.upper()}-{c}" for b, c in zip(titles.K.BRANDS, titles.K.BRANDS[3:])]
    names += ["", "  ", None, " dior sauvage ", "Lancôme", "lancome idole", "Hermès/Chloé", "(creed)", "creed2", "creed_", "Police Coach Guess", "dior dior"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    for own, vendor in ((titles.brand_from_title, False), (titles.brand_from_vendor, True)):
        expected = {r.i: r.brand for r in rows.select("i", own(F.col("name")).alias("brand")).collect()}
        assert {r.i: r.brand for r in titles.brands_by_table(rows, "name", table, vendor).collect()} == expected
    none = titles.brand_table(spark.createDataFrame([("",), (None,)], "brand string"))
    assert {r.brand for r in titles.brands_by_table(rows, "name", none).collect()} == {"Unknown"}


def test_jdbc_ranges(spark):
    """On the embedded database that comes with Spark."""
    own = {"url": "jdbc:derby:memory:prices;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(1000).selectExpr("CASE WHEN id % 10 > 0 THEN id END AS ID", "CAST(id AS STRING) AS NAME", "timestamp_seconds(id * 3600) AS SEEN", "CAST(id AS DECIMAL(12,2)) / 7 AS PRICE")
    rows.write.format("jdbc").options(**own, dbtable="items").mode("overwrite").save()
    plain = tables.load_table(spark, "items", jdbc=own)
    expected = sorted(map(repr, plain.collect()))
    assert plain.rdd.getNumPartitions() == 1 and len(expected) == 1000
    for column in ("ID", "SEEN", "PRICE"):
        cut = tables.load_table(spark, "items", jdbc=own, partition_column=column, rows_a_partition=300)
        assert cut.rdd.getNumPartitions() == 4 and sorted(map(repr, cut.collect())) == expected
        sizes = [n for (n,) in cut.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert len(sizes) == 4 and max(sizes) < 400
    assert tables.load_table(spark, "items", jdbc=own, partition_column="ID", rows_a_partition=1, connections=8).rdd.getNumPartitions() == 8
    plan = cut.where("ID > 900").select("NAME")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ID,900)" in plan and "PRICE" not in plan.split("ReadSchema")[1]
    rows.limit(0).write.format("jdbc").options(**own, dbtable="nothing").mode("overwrite").save()
    assert tables.load_table(spark, "nothing", jdbc=own, partition_column="ID").count() == 0


def test_a_repeated_run_takes_the_place_of_its_rows(spark, tmp_path):
    raw = spark.createDataFrame([("a", START, 1), ("a", START + dt.timedelta(days=40), 2), ("b", START, 3)], "source_id string, scraped_at timestamp, v int")
    for run, rows in (("r/1", raw), ("r2", raw.where("v = 1")), ("r/1", raw.where("v > 1"))):
        tables.archive_raw(rows, f"{tmp_path}/raw", run_id=run)
        tables.append_history(rows.withColumnRenamed("scraped_at", "recorded_at"), f"{tmp_path}/history", run_id=run)
    for found in (tables.replay_raw(spark, f"{tmp_path}/raw"), spark.read.parquet(f"{tmp_path}/history")):
        assert sorted((r.run_id, r.v) for r in found.collect()) == [("r/1", 2), ("r/1", 3), ("r2", 1)]
    assert tables.replay_raw(spark, f"{tmp_path}/raw", "b").count() == 1
