"""Change detection: raw listings against a current-state snapshot, as set operations.

A listing is keyed by (source_id, source_external_id).  Within a batch rows are ordered by
(scraped_at, pos); the first is compared with the snapshot, each later one with the row before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewatch_spark.functions.text import MONEY, external_id, state_hash

KEY = ["source_id", "source_external_id"]
#: What is needed of an observed row besides its key and order; availability and hash follow from price and stock.
FACTS = ("price", "observed_stock", "stock_confidence", "source_currency", "raw_title", "url", "image_url", "moq", "bulk_tiers")
TIERS = "array<struct<qty int, price decimal(12,2)>>"


def extract_stock(source_type: Column, inventory_quantity: Column, stock_text: Column, stock: Column) -> Column:
    """Stock by source type, then the generic fields."""
    quantity = inventory_quantity.try_cast("int")
    text = F.lower(stock_text)
    counted = F.regexp_extract(text, r"(\d+)\s+in stock", 1).try_cast("int")
    from_text = F.when(text.contains("out of stock"), F.lit(0)).when(counted.isNotNull(), counted).when(text.contains("in stock"), F.lit(1))
    return F.coalesce(
        F.when(source_type == "shopify", quantity),
        F.when(source_type.isin("bs4_woocommerce", "woocommerce"), from_text),
        stock.try_cast("int"),
        quantity,
    )


def stock_confidence(business_type: Column, inventory_quantity: Column, stock_text: Column, stock: Column, available: Column) -> Column:
    b2b = business_type == "B2B_WHOLESALE"
    return (
        F.when((b2b | business_type.isNull()) & inventory_quantity.try_cast("int").isNotNull(), "HIGH")
        .when(F.lower(stock_text).contains("in stock"), "MEDIUM")
        .when(stock.try_cast("int").isNotNull() & b2b, "HIGH")
        .when(stock.try_cast("int").isNotNull(), "MEDIUM")
        .when(available, "LOW")
        .otherwise("UNKNOWN")
    )


def availability(stock: Column) -> Column:
    return F.when(stock.isNull(), "UNKNOWN").when(stock > 0, "AVAILABLE_IN_STOCK").otherwise("OUT_OF_STOCK")


def observed_price(c: Column) -> Column:
    return c.try_cast(MONEY)


def with_quantities(df: DataFrame) -> DataFrame:
    """df with moq and bulk_tiers in the types of the snapshot, null where df has none or they can't be read."""
    own = lambda c, kind: F.col(c).cast("string").try_cast(kind) if c == "moq" else F.col(c).cast(kind)
    return df.withColumns({c: own(c, kind) if c in df.columns else F.lit(None).cast(kind) for c, kind in (("moq", "int"), ("bulk_tiers", TIERS))})


def observe(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """raw with the facts that change detection needs; sources is a dimension of a row a shop."""
    facts = sources.select("source_id", "engine_type", "business_type", F.col("currency").alias("source_currency"))
    text = lambda c: F.col(c).cast("string")
    rows = with_quantities(raw).join(facts, "source_id", "left").withColumns(
        {
            "price": observed_price(text("price")),
            "observed_stock": extract_stock(F.col("engine_type"), text("inventory_quantity"), text("stock_text"), text("stock")),
            "stock_confidence": stock_confidence(F.col("business_type"), text("inventory_quantity"), text("stock_text"), text("stock"), F.col("available")),
            "source_external_id": external_id(F.col("sku"), F.col("raw_title"), F.col("url")),
        }
    )
    return with_state(rows)


def with_state(rows: DataFrame) -> DataFrame:
    """rows with availability and hash, which follow from price and observed_stock."""
    rows = rows.withColumn("availability", availability(F.col("observed_stock")))
    return rows.withColumn("hash", state_hash(F.col("price"), F.col("observed_stock"), F.col("availability")))


def spoilt() -> Column:
    """Whether a row fails by itself: a blank title, negative stock."""
    return F.coalesce((F.trim(F.coalesce("raw_title", F.lit(""))) == "") | (F.col("observed_stock") < 0), F.lit(False))


def classify_changes(observed: DataFrame, snapshot: DataFrame, buckets: int | None = None) -> DataFrame:
    """observed with change (created, changed, unchanged, failed) and the state before.

    Spoilt rows fail alone, as rows do whose column rejected (if there is one) says so.  Rows are dealt once by the listing key, whatever
    dealt them before (a source holds too many rows for one task): the window, the join and what
    next_snapshot aggregates keep that partitioning.  buckets: how many buckets a snapshot bucketed by
    the key has; it is then read in place.  observed may lack availability and hash, which follow from price
    and stock: they are then told after the dealing and not dealt.
    """
    failed = spoilt() | F.coalesce("rejected", F.lit(False)) if "rejected" in observed.columns else spoilt()
    rows = observed.withColumn("failed", failed)
    rows = rows.repartition(buckets, *KEY) if buckets else rows.repartition(*KEY)
    rows = rows if "hash" in rows.columns else with_state(rows)
    order = Window.partitionBy(*KEY, "failed").orderBy("scraped_at", "pos")
    rows = rows.withColumns(
        {
            "lag_hash": F.lag("hash").over(order),
            "lag_price": F.lag("price").over(order),
            "lag_availability": F.lag("availability").over(order),
            "seen_before": F.row_number().over(order) > 1,
        }
    )
    known = snapshot.select(
        *KEY,
        F.col("current_hash").alias("known_hash"),
        F.col("current_price").alias("known_price"),
        F.col("availability").alias("known_availability"),
        F.lit(True).alias("known"),
    )
    rows = rows.join(known, KEY, "left")
    before = lambda mine, theirs: F.when(F.col("seen_before"), F.col(mine)).otherwise(F.col(theirs))
    rows = rows.withColumns(
        {
            "prev_hash": before("lag_hash", "known_hash"),
            "prev_price": before("lag_price", "known_price"),
            "prev_availability": before("lag_availability", "known_availability"),
        }
    )
    exists = F.col("seen_before") | F.coalesce("known", F.lit(False))
    change = F.when(F.col("failed"), "failed").when(~exists, "created").when(F.col("prev_hash") == F.col("hash"), "unchanged").otherwise("changed")
    return rows.withColumn("change", change).drop("lag_hash", "lag_price", "lag_availability", "known_hash", "known_price", "known_availability", "known", "seen_before", "failed")


def next_snapshot(changes: DataFrame, snapshot: DataFrame, reference_mode: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """The snapshot after a batch: the last created or changed row wins; its empty values, an MOQ of 0
    and tiers without an entry keep what was known.

    A row with the state that was known moves last_seen_at, last_scraped_at and stock_confidence alone.
    reference_mode: a delisted listing seen again with its old state stays delisted.  carry: further
    columns of both that a listing keeps from the first row that has them.
    """
    changes, snapshot = with_quantities(changes), with_quantities(snapshot)
    snapshot = snapshot.withColumns({c: F.lit(None).cast(kind) for c, kind in (("title", "string"), ("last_scraped_at", "timestamp")) if c not in snapshot.columns})
    order = F.struct("scraped_at", "pos")
    wrote = F.col("change").isin("created", "changed")
    filled = lambda c, full: F.max_by(c, F.when(wrote & full, order))
    text = lambda c: filled(c, F.coalesce(F.col(c), F.lit("")) != "")
    sure = F.col("stock_confidence").isin("HIGH", "MEDIUM")
    batch = changes.where("change <> 'failed'").groupBy(*KEY).agg(
        F.max_by(F.struct("hash", "price", "observed_stock", "availability", "raw_title", "source_currency"), F.when(wrote, order)).alias("n"),
        F.max_by(F.struct("stock_confidence", "availability"), order).alias("s"),
        text("url").alias("n_url"),
        text("image_url").alias("n_image_url"),
        filled("moq", F.col("moq") != 0).alias("n_moq"),
        filled("bulk_tiers", F.size("bulk_tiers") > 0).alias("n_bulk_tiers"),
        F.max("scraped_at").alias("n_seen"),
        F.max(F.when(wrote & sure, F.col("scraped_at"))).alias("n_confirmed"),
        *(F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"n_{c}") for c in carry),
    )
    joined = snapshot.join(batch, KEY, "full_outer")
    moved = F.col("n").isNotNull()
    put = lambda new, old: F.when(moved, F.col(new)).otherwise(F.col(old)).alias(old)
    state = F.when(moved, F.col("n.availability")).otherwise(F.col("availability"))
    if not reference_mode:
        state = F.when((F.col("availability") == "DELISTED") & F.col("s").isNotNull(), F.col("s.availability")).otherwise(state)
    return joined.select(
        *KEY,
        put("n.hash", "current_hash"),
        put("n.price", "current_price"),
        put("n.observed_stock", "current_stock"),
        state.alias("availability"),
        F.when(F.col("s").isNotNull(), F.col("s.stock_confidence")).otherwise(F.col("stock_confidence")).alias("stock_confidence"),
        F.coalesce("n_url", "url").alias("url"),
        F.coalesce("n_image_url", "image_url").alias("image_url"),
        F.coalesce("currency", "n.source_currency", F.lit("CLP")).alias("currency"),
        F.coalesce("n_confirmed", "last_confirmed_stock_at").alias("last_confirmed_stock_at"),
        F.greatest("n_seen", "last_seen_at").alias("last_seen_at"),
        F.coalesce("n_moq", "moq").alias("moq"),
        F.coalesce("n_bulk_tiers", "bulk_tiers").alias("bulk_tiers"),
        put("n.raw_title", "title"),
        F.greatest("n_seen", "last_scraped_at").alias("last_scraped_at"),
        *(F.coalesce(c, f"n_{c}").alias(c) for c in carry),
    )


def history_rows(changes: DataFrame) -> DataFrame:
    """New listings with a price, and changes of price or availability; a change of stock alone writes none."""
    differs = ~F.col("price").eqNullSafe(F.col("prev_price")) | ~F.col("availability").eqNullSafe(F.col("prev_availability"))
    kept = F.col("price").isNotNull() & ((F.col("change") == "created") | ((F.col("change") == "changed") & differs))
    return changes.where(kept).select(*KEY, "price", F.col("observed_stock").alias("stock"), "availability", F.col("scraped_at").alias("recorded_at"), "pos")


def merge_by_signature(listings: DataFrame) -> DataFrame:
    """listings re-keyed: one listing for each (product, source, signature); no signature, no merge."""
    w = Window.partitionBy("product_id", "source_id", "variant_signature").orderBy("first_seen_at", "listing_id")
    first = F.first_value("listing_id").over(w)
    return listings.withColumn("merged_listing_id", F.when(F.col("variant_signature").isNotNull(), first).otherwise(F.col("listing_id")))


def delist_stale(snapshot: DataFrame, as_of: Column, minutes: int = 1440) -> DataFrame:
    stale = (F.col("availability") != "DELISTED") & (F.col("last_seen_at") < as_of - F.make_interval(mins=F.lit(minutes)))
    return snapshot.withColumn("availability", F.when(stale, "DELISTED").otherwise(F.col("availability")))


def run_counters(changes: DataFrame, by: str = "run_id") -> DataFrame:
    """extracted, updated, skipped, failed, items_with_stock and the run's status."""
    out = changes.groupBy(by).agg(
        F.count(F.lit(1)).alias("extracted"),
        F.count_if(F.col("change").isin("created", "changed")).alias("updated"),
        F.count_if(F.col("change") == "unchanged").alias("skipped"),
        F.count_if(F.col("change") == "failed").alias("failed"),
        F.count_if(F.col("observed_stock").isNotNull()).alias("items_with_stock"),
    )
    return out.withColumn("status", F.when(F.col("extracted") == 0, "EMPTY").when(F.col("failed") > 0, "PARTIAL").otherwise("SUCCESS"))


def state_periods(history: DataFrame, key: list[str], state: list[str], at: str, *tie: str, ends: bool = False) -> DataFrame:
    """Runs of equal states as periods: key, state, valid_from, valid_to (null: still valid), points; ends: with first and last, the (at, tie) of their outer points."""
    order = Window.partitionBy(*key).orderBy(at, *tie)
    now = F.struct(*state)
    marked = history.withColumn("_new", F.when(F.lag(now).over(order).eqNullSafe(now), 0).otherwise(1))
    numbered = marked.withColumn("_period", F.sum("_new").over(order))
    point = F.struct(at, *tie)
    outer = [F.min(point).alias("first"), F.max(point).alias("last")] if ends else []
    periods = numbered.groupBy(*key, "_period", *state).agg(F.min(at).alias("valid_from"), F.count(F.lit(1)).alias("points"), *outer)
    return periods.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(*key).orderBy("_period"))).withColumnRenamed("_period", "period")
