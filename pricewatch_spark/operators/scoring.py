"""Source reliability, summaries, run statistics and scheduling questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_reliability(sources: DataFrame, listings: DataFrame) -> DataFrame:
    """50 + 50 * share of listings of high or medium stock confidence, as a whole number; others keep their score."""
    sure = F.col("stock_confidence").isin("HIGH", "MEDIUM")
    counted = listings.groupBy("source_id").agg(F.count_if(sure).alias("sure"), F.count(F.lit(1)).alias("listings"))
    scored = sources.join(counted, "source_id", "left")
    fresh = F.expr("50 + (50 * sure) div listings")
    return scored.withColumn("reliability_score", F.when(F.col("is_active") & (F.col("listings") > 0), fresh).otherwise(F.col("reliability_score")))


def upsert_monthly_scores(current: DataFrame, new: DataFrame, month: str) -> DataFrame:
    """(source_id, month) rows; on update only accuracy and rate change."""
    fresh = new.select("source_id", F.lit(month).alias("month"), F.col("accuracy").alias("n_accuracy"), F.col("rate").alias("n_rate"))
    both = current.join(fresh, ["source_id", "month"], "full_outer")
    return both.withColumns({"accuracy": F.coalesce("n_accuracy", "accuracy"), "rate": F.coalesce("n_rate", "rate")}).drop("n_accuracy", "n_rate")


def catalog_summary(raw: DataFrame, by: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Rows, distinct brands (non-empty), with price, with image; by: groups, subtotals included."""
    brand = F.when(F.col("vendor") != "", F.col("vendor"))
    measures = [
        F.count(F.lit(1)).alias("items"),
        (F.approx_count_distinct(brand) if approximate else F.count_distinct(brand)).alias("brands"),
        F.count_if(F.col("price") > 0).alias("with_price"),
        F.count_if(F.coalesce("image_url", F.lit("")) != "").alias("with_image"),
    ]
    return raw.rollup(*by).agg(*measures) if by else raw.agg(*measures)


def catalog_sketches(raw: DataFrame, by: list[str], distinct: list[str], bits: int = 12) -> DataFrame:
    """Mergeable states of a summary: items, with_price, with_image and a sketch of the distinct values of each column.

    One state a group (by: a source's day, say), of 2 ** bits bytes at most a column; blank and null values don't count.
    A day's states are computed once from that day's rows.
    """
    sketches = [F.hll_sketch_agg(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")), F.lit(bits)).alias(c) for c in distinct]
    priced, pictured = F.count_if(F.col("price") > 0), F.count_if(F.coalesce("image_url", F.lit("")) != "")
    return raw.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), priced.alias("with_price"), pictured.alias("with_image"), *sketches)


def summary_of_sketches(states: DataFrame, distinct: list[str], by: list[str] | None = None) -> DataFrame:
    """catalog_sketches' states put together: sums, and estimates of the distinct values; by: groups, subtotals included.

    Estimates have a relative standard error of 1.04 / sqrt(2 ** bits), 1.6 % by default, and are exact to rounding for
    a few values; the order and the grouping of the states don't matter.
    """
    sums = [F.sum(c).alias(c) for c in ("items", "with_price", "with_image")]
    sketches = [F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in distinct]
    return states.rollup(*by).agg(*sums, *sketches) if by else states.agg(*sums, *sketches)


def quality_report(listings: DataFrame, products: DataFrame, history: DataFrame) -> DataFrame:
    """By source: listings, distinct products, missing fields, history points."""
    points = history.groupBy("source_id").agg(F.count(F.lit(1)).alias("history_points"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    joined = listings.join(products.select("product_id", "brand", "product_name", "fragrance_type", "volume_ml"), "product_id", "left")
    report = joined.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("listings"),
        F.count_distinct("product_id").alias("products"),
        F.count_if(empty("url")).alias("no_url"),
        F.count_if(empty("image_url")).alias("no_image"),
        F.count_if(F.col("brand").isNull()).alias("no_brand"),
        F.count_if(F.col("product_name").isNull()).alias("no_name"),
        F.count_if(F.col("fragrance_type").isNull()).alias("no_type"),
        F.count_if(F.col("volume_ml").isNull()).alias("no_volume"),
    )
    return report.join(points, "source_id", "left").withColumn("history_points", F.coalesce("history_points", F.lit(0)))


def listing_report(listings: DataFrame, history: DataFrame, key: list[str]) -> DataFrame:
    """listings with history_points, the number of points of each."""
    points = history.groupBy(*key).agg(F.count(F.lit(1)).alias("history_points"))
    return listings.join(points, key, "left").withColumn("history_points", F.coalesce("history_points", F.lit(0)))


def items_with_stock(raw: DataFrame, by: str = "run_id") -> DataFrame:
    return raw.groupBy(by).agg(F.count_if(F.col("stock").isNotNull()).alias("items_with_stock"))


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy("name")


def recent_logs(logs: DataFrame, source_id: int | None = None, limit: int = 20) -> DataFrame:
    own = logs if source_id is None else logs.where(F.col("source_id") == source_id)
    return own.orderBy(F.desc("started_at"), F.desc("log_id")).limit(min(limit, 100))


def sources_due(sources: DataFrame, queue: DataFrame, logs: DataFrame, as_of: Column, hours: int = 4) -> DataFrame:
    """Active sources with nothing pending or running whose last good run is older than the interval."""
    waiting = queue.where(F.col("status").isin("PENDING", "RUNNING")).select("source_id")
    last = logs.where(F.col("status").isin("SUCCESS", "PARTIAL")).groupBy("source_id").agg(F.max("started_at").alias("last_run"))
    free = sources.where("is_active").join(waiting, "source_id", "left_anti").join(last, "source_id", "left")
    return free.where(F.col("last_run").isNull() | (F.col("last_run") <= as_of - F.make_interval(hours=F.lit(hours))))


def enqueue_all(sources: DataFrame, queue: DataFrame, priority: int = 5, exclude_like: str | None = None) -> DataFrame:
    pending = queue.where("status = 'PENDING'").select("source_id")
    rows = sources.where("is_active").join(pending, "source_id", "left_anti")
    if exclude_like:
        rows = rows.where(~F.col("name").like(exclude_like))
    return rows.select("source_id", F.lit("PENDING").alias("status"), F.lit(priority).alias("priority"))


def next_jobs(queue: DataFrame, as_of: Column, k: int = 1) -> DataFrame:
    due = queue.where((F.col("status") == "PENDING") & (F.col("scheduled_at") <= as_of))
    return due.orderBy(F.desc("priority"), "scheduled_at", "job_id").limit(k)


def run_stats(logs: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """By source and day: runs, runs of each status, failed share in permille, last good run, mean records and seconds.

    Seconds are of the runs that have ended_at; null without any, or if logs has no such column.
    """
    ended = F.col("ended_at") if "ended_at" in logs.columns else F.lit(None).cast("timestamp")
    micros = F.unix_micros(ended.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return logs.groupBy("source_id", F.to_date("started_at").alias("day")).agg(
        F.count(F.lit(1)).alias("runs"),
        *(F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in statuses),
        F.expr("(1000 * count_if(status = 'FAILED')) div count(1)").alias("failed_permille"),
        F.max(F.when(F.col("status") == "SUCCESS", F.col("started_at"))).alias("last_success"),
        F.avg("records").alias("mean_records"),
        (F.avg(micros) / 1e6).alias("mean_seconds"),
    )
