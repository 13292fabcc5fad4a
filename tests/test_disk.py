"""What jobs leave on disk: tables by column, compressed, and gone when they are cleared."""

from pathlib import Path

from test_ingest import LISTINGS, RAW

from pricewatch_spark.operators import ingest
from pricewatch_spark.sources.tables import shared_folder
from pricewatch_spark.streaming import changes as stream


def held(spark):
    root = Path(shared_folder(spark).removeprefix("file://"))
    return sum(f.stat().st_size for f in root.rglob("*") if f.is_file())


def many_rows(spark, n):
    """n rows of n / 8 listings in three shops, in prices that change."""
    row = {
        "run_id": "'run'", "source_id": "elt(1 + id % 3, 'a', 'b', 'c')", "pos": "id", "scraped_at": "TIMESTAMP '2026-03-01' + make_dt_interval(0, 0, 0, id)",
        "raw_title": "concat('Dior Alba', id % 7, ' EDP ', 10 * (1 + id % 9), ' ml')", "price": "CAST(id * 7919 % 5 AS STRING)", "stock": "CAST(id % 4 AS STRING)", "sku": f"concat('s', id % {n // 8})",
        "url": "concat('https://shop/', id)", "image_url": "concat('https://img/', id)", "vendor": "CAST(NULL AS STRING)", "tags": "CAST(array() AS ARRAY<STRING>)", "barcode": "CAST(NULL AS STRING)",
        "inventory_quantity": "CAST(NULL AS STRING)", "stock_text": "CAST(NULL AS STRING)", "available": "true",
    }
    return spark.range(n).selectExpr(*(f"{of} AS {name}" for name, of in row.items()))


def test_a_run_keeps_little_and_both_ways_agree(spark):
    n = 24_000
    shops = spark.createDataFrame([(s, "other", "B2B_WHOLESALE", "CLP") for s in "abc"], "source_id string, engine_type string, business_type string, currency string")
    known, snapshot = spark.createDataFrame([], ingest.PRODUCTS), spark.createDataFrame([], LISTINGS)
    before = held(spark)
    done = [ingest.ingest(many_rows(spark, n), shops, known, snapshot, once=once) for once in (True, False)]
    assert (held(spark) - before) / (2 * n) < 100  # bytes a row; checkpoints took 414 on six times sf0.1
    for of in ("listings", "history", "counters", "rejects", "products"):
        one, other = (getattr(x, of) for x in done)
        assert one.count() > 0 or of == "rejects"
        assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
    kept = held(spark)
    done[0].kept.clear()
    done[1].kept.clear()
    assert held(spark) < before + (kept - before) / 2


def test_a_stream_of_batches_leaves_the_snapshot_and_history_alone(spark, tmp_path):
    n = 24_000
    shops = spark.createDataFrame([(s, "other", "B2B_WHOLESALE", "CLP") for s in "abc"], "source_id string, engine_type string, business_type string, currency string")
    rows = many_rows(spark, n).drop("vendor", "tags", "barcode")
    before = held(spark)
    for k in range(2):
        rows.where(f"pos % 2 = {k}").write.parquet(f"{tmp_path}/in/{k}")
        files = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        stream.run_delta_stream(files, shops, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert stream.read_snapshot(spark, f"{tmp_path}/out").count() == n // 8
    assert held(spark) - before < n  # whole checkpoints of both batches, several hundred bytes a row, stayed here
