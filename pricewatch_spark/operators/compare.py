"""Price comparison across sources, search, nested listings.

The comparison of all products is one aggregation by product: minima, pivot and the list of
offers come out of the same shuffle, and the names at the minimum are read off that list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewatch_spark.functions.text import display_name

COLUMNS = 10


def number_sources(sources: DataFrame) -> DataFrame:
    """Active sources numbered by name; a dimension of a row a shop, so one window is fine."""
    return sources.where("is_active").withColumn("src_num", F.row_number().over(Window.orderBy("name")))


def listings_grid(listings: DataFrame, sources: DataFrame) -> DataFrame:
    """product_id, price, flag (Sí, No, ?), source name and number, of active sources."""
    numbered = number_sources(sources).select("source_id", F.col("name").alias("source_name"), "src_num")
    flag = F.when(F.col("availability") == "AVAILABLE_IN_STOCK", "Sí").when(F.col("availability") == "UNKNOWN", "?").otherwise("No")
    return listings.join(numbered, "source_id").select("product_id", F.col("current_price").alias("price"), flag.alias("flag"), "source_name", "src_num")


def min_prices(grid: DataFrame) -> DataFrame:
    return grid.groupBy("product_id").agg(F.min("price").alias("min_price"), F.min(F.when(F.col("flag") == "Sí", F.col("price"))).alias("min_price_in_stock"))


def _names_at(offers: str, price: str, in_stock: bool):
    at = F.filter(F.col(offers), lambda o: (o["price"] == F.col(price)) & ((o["flag"] == "Sí") if in_stock else F.lit(True)))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(at, lambda o: o["source_name"]))), ", ")
    return F.when(F.col(price).isNotNull(), names)


def cheapest_sources(grid: DataFrame) -> DataFrame:
    """Names of the sources at the minimum, overall and in stock."""
    found = grid.groupBy("product_id").agg(
        F.min("price").alias("min_price"),
        F.min(F.when(F.col("flag") == "Sí", F.col("price"))).alias("min_price_in_stock"),
        F.collect_set(F.struct("price", "flag", "source_name")).alias("offers"),
    )
    return found.select("product_id", _names_at("offers", "min_price", False).alias("cheapest"), _names_at("offers", "min_price_in_stock", True).alias("cheapest_in_stock"))


def _pivot(n: int):
    for k in range(1, n + 1):
        here = F.col("src_num") == k
        yield F.max(F.when(here, F.col("price"))).alias(f"price_{k}")
        yield F.max(F.when(here, F.col("flag"))).alias(f"stock_{k}")


def pivot_sources(grid: DataFrame, n: int = COLUMNS) -> DataFrame:
    """n pairs (price_k, stock_k); price and flag are maxima taken apart."""
    return grid.groupBy("product_id").agg(*_pivot(n))


def price_gap(own, lowest):
    """(own - lowest) / lowest in percent, two decimals; null if the lowest isn't positive."""
    return F.when(lowest > 0, F.round((own - lowest) * 100 / lowest, 2))


def own_price_gap(minima: DataFrame, own_prices: DataFrame) -> DataFrame:
    joined = minima.join(own_prices, "product_id", "left")
    return joined.withColumn("gap_pct", price_gap(F.col("own_price"), F.col("min_price"))).withColumn("gap_in_stock_pct", price_gap(F.col("own_price"), F.col("min_price_in_stock")))


def price_comparison(products: DataFrame, listings: DataFrame, sources: DataFrame, own: DataFrame | None = None, n: int = COLUMNS) -> DataFrame:
    """One row a product that has an offer of an active source."""
    found = (
        listings_grid(listings, sources)
        .groupBy("product_id")
        .agg(
            F.min("price").alias("min_price"),
            F.min(F.when(F.col("flag") == "Sí", F.col("price"))).alias("min_price_in_stock"),
            F.collect_set(F.struct("price", "flag", "source_name")).alias("offers"),
            *_pivot(n),
        )
    )
    found = found.withColumns({"cheapest": _names_at("offers", "min_price", False), "cheapest_in_stock": _names_at("offers", "min_price_in_stock", True)}).drop("offers")
    header = products.select(
        "product_id", "product_code", "ean_13", display_name(F.col("brand"), F.col("product_name"), F.col("variant"), F.col("volume_ml")).alias("display_name")
    )
    out = header.join(found, "product_id")
    if own is None:
        return out.withColumn("own_price", F.lit(None).cast("decimal(12,2)")).withColumn("gap_pct", F.lit(None).cast("decimal(12,2)"))
    return own_price_gap(out, own).drop("gap_in_stock_pct")


def side_by_side(products: DataFrame, listings: DataFrame, sources: DataFrame) -> DataFrame:
    """Offers of each product: in stock first, then by price (nulls last), then by source name."""
    named = listings.join(sources.where("is_active").select("source_id", F.col("name").alias("source_name"), "reliability_score"), "source_id")
    order = Window.partitionBy("product_id").orderBy(
        F.when(F.col("availability") == "AVAILABLE_IN_STOCK", 0).otherwise(1), F.col("current_price").asc_nulls_last(), F.col("source_name").asc()
    )
    return named.withColumn("place", F.row_number().over(order)).join(products.select("product_id", "product_code"), "product_id")


def best_in_stock(listings: DataFrame, sources: DataFrame) -> DataFrame:
    """The first of the lowest in-stock prices; price 0 and null don't count."""
    named = listings.join(sources.where("is_active").select("source_id", F.col("name").alias("source_name")), "source_id")
    offers = named.where((F.col("availability") == "AVAILABLE_IN_STOCK") & (F.col("current_price") > 0))
    best = offers.groupBy("product_id").agg(F.min(F.struct("current_price", "source_name")).alias("best"))
    return best.select("product_id", F.col("best.current_price").alias("best_price"), F.col("best.source_name").alias("best_source"))


def price_range(listings: DataFrame) -> DataFrame:
    priced = F.when(F.col("current_price") != 0, F.col("current_price"))
    return listings.groupBy("product_id").agg(F.min(priced).alias("min_price"), F.max(priced).alias("max_price"), F.avg(priced).alias("avg_price"), F.count(priced).alias("offers"))


def search_products(
    products: DataFrame, listings: DataFrame, brand: str | None = None, fragrance_type: str | None = None, gender: str | None = None, ml: int | None = None, in_stock: bool = False, skip: int = 0, limit: int = 50
) -> DataFrame:
    """A page of products by brand, name and code; at most 500."""
    out = products
    if brand:
        out = out.where(F.col("brand").ilike(f"%{brand}%"))
    for column, value in (("fragrance_type", fragrance_type), ("gender", gender), ("volume_ml", ml)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if in_stock:
        out = out.join(listings.where("availability = 'AVAILABLE_IN_STOCK'").select("product_id"), "product_id", "left_semi")
    return out.orderBy(F.col("brand").asc_nulls_last(), F.col("product_name").asc_nulls_last(), "product_code").offset(skip).limit(min(limit, 500))


def products_with_listings(products: DataFrame, listings: DataFrame) -> DataFrame:
    """product with an array of its listings, ordered by source."""
    nested = listings.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "current_price", "availability"))).alias("listings"))
    return products.join(nested, "product_id", "left")
