"""Versions of the snapshot: partial rewrites, growing buckets, repeated commits, collection, plans."""

import re

from pyspark.sql import functions as F

from pricewatch_spark.operators import delta
from pricewatch_spark.plans.testmap import Model
from pricewatch_spark.sources.snapshots import SnapshotStore, save_bucketed, upsert_version

SF = "/root/testdata/sf0.001"
SCHEMA = "source_id string, source_external_id string, v int"


def listings(spark, ids, v):
    return spark.createDataFrame([("s", str(i), v) for i in ids], SCHEMA)


def put(store, version, rows):
    """rows take the place of the listings of their keys."""
    return upsert_version(store, version, rows, lambda before: before.join(rows.select(*delta.KEY), delta.KEY, "left_anti").unionByName(rows))


def content(store, version=None):
    return sorted((int(r.source_external_id), r.v) for r in store.read(store.manifest(version)).collect())


def test_versions(spark, tmp_path):
    store = SnapshotStore(spark, f"{tmp_path}/s", SCHEMA, buckets=4, rows_a_bucket=10)
    assert content(store) == [] and store.versions() == []
    first = put(store, 0, listings(spark, range(30), 0))
    assert first.buckets == 4 and first.rows == 30
    one = put(store, 1, listings(spark, [7], 1))
    # one bucket is new, the others are those of version 0
    assert sorted(v for v, _ in one.written.values()).count(1) == 1 and one.rows == 30
    assert content(store) == [(i, int(i == 7)) for i in range(30)] and content(store, 0) == [(i, 0) for i in range(30)]
    assert put(store, 1, listings(spark, [7], 1)) == one
    more = put(store, 2, listings(spark, range(100, 200), 2))
    assert more.buckets == 16 and more.rows == 130
    assert put(store, 2, listings(spark, range(100, 200), 2)).rows == 130
    expected = [(i, int(i == 7)) for i in range(30)] + [(i, 2) for i in range(100, 200)]
    assert content(store) == expected
    last = put(store, 3, listings(spark, [100], 3))
    assert sum(v == 3 for v, _ in last.written.values()) == 1
    assert store.collect(keep=1) > 0 and store.versions() == [3]
    assert content(store) == sorted(expected[:30] + [(100, 3)] + expected[31:])
    assert put(store, 4, listings(spark, [], 0)).rows == 130 and len(content(store)) == 130
    # a manifest that is not complete does not count
    (tmp_path / "s/manifests/v000000009").mkdir()
    assert store.versions() == [3, 4]


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (\w+\([^\n]*)", text), text


def test_change_detection_deals_rows_once_by_listing(spark):
    m = Model(spark, SF)
    empty = spark.createDataFrame([], "source_id long, source_external_id string, current_hash string, current_price decimal(12,2), current_stock int, availability string, stock_confidence string, url string, image_url string, currency string, last_confirmed_stock_at timestamp, last_seen_at timestamp")
    for limit in ("10m", "-1"):  # with sources by broadcast, and by a shuffle
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            changes = delta.classify_changes(delta.observe(m.chains, m.sources), empty.repartition(2))
            found, _ = exchanges(delta.next_snapshot(changes, empty.repartition(2)))
            by_key = [x for x in found if "source_external_id" in x and "hashpartitioning(source_id" in x]
            # the batch once, the snapshot once for either join
            assert len(by_key) == 3, found
            assert sum("source_id" in x and "source_external_id" not in x for x in found) == (0 if limit == "10m" else 2)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_bucketed_snapshot_is_read_in_place(spark):
    m = Model(spark, SF)
    observed = delta.observe(m.chains, m.sources)
    empty = spark.createDataFrame([], "source_id long, source_external_id string, current_hash string, current_price decimal(12,2), current_stock int, availability string, stock_confidence string, url string, image_url string, currency string, last_confirmed_stock_at timestamp, last_seen_at timestamp")
    first = delta.next_snapshot(delta.classify_changes(observed, empty), empty)
    save_bucketed(first, "snapshot_in_buckets", 6)
    known = spark.table("snapshot_in_buckets")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        after = delta.next_snapshot(delta.classify_changes(observed, known, buckets=6), known)
        found, text = exchanges(after)
        assert sum("hashpartitioning(source_id" in x and "source_external_id" in x for x in found) == 1, text
        assert after.where(F.col("current_hash").isNull()).count() == 0 and after.count() == first.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sql("DROP TABLE snapshot_in_buckets")
