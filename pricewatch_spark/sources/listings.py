"""Raw listings from product feeds (JSON) and wholesale tables (HTML), with built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewatch_spark.functions.text import clean_text, compose_title, detect_out_of_stock, net_or_gross_price, parse_price, split_ean_sku, strip_box_note, strip_html, validate_ean, variant_title

VARIANT = "struct<title: string, price: string, sku: string, barcode: string, available: boolean, inventory_quantity: int>"
FEED = f"products array<struct<title: string, body_html: string, vendor: string, handle: string, tags: array<string>, images: array<struct<src: string>>, variants: array<{VARIANT}>>>"


def read_feed_json(feeds: DataFrame, body: str = "body", base_url: str = "base_url") -> DataFrame:
    """feeds (source_id, base_url, body) -> one row a variant; products without variants give none.

    The feed tells no MOQ and no tiers: they are null and empty, as the columns of a raw listing.
    """
    parsed = feeds.select("source_id", F.col(base_url).alias("base_url"), F.from_json(F.col(body), FEED).alias("feed"))
    products = parsed.select("source_id", "base_url", F.explode("feed.products").alias("p"))
    rows = products.select("source_id", "base_url", "p", F.explode("p.variants").alias("v"))
    trimmed = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select(
        "source_id",
        variant_title(F.col("p.title"), F.col("v.title")).alias("raw_title"),
        F.coalesce(F.col("v.price").try_cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)")).alias("price"),
        F.concat(F.regexp_replace("base_url", "/+$", ""), F.lit("/products/"), F.coalesce("p.handle", F.lit(""))).alias("url"),
        trimmed(F.col("p.vendor")).alias("vendor"),
        trimmed(F.col("v.sku")).alias("sku"),
        validate_ean(F.col("v.barcode")).alias("barcode"),
        strip_html(F.coalesce("p.body_html", F.lit(""))).alias("description"),
        F.coalesce(F.get(F.col("p.images"), F.lit(0))["src"], F.lit("")).alias("image_url"),
        F.filter(F.transform(F.coalesce("p.tags", F.array().cast("array<string>")), F.trim), lambda t: t != "").alias("tags"),
        F.col("v.inventory_quantity").alias("inventory_quantity"),
        F.col("v.available").alias("available"),
        F.col("v.inventory_quantity").alias("stock"),
        F.lit(None).cast("int").alias("moq"),
        F.array().cast("array<struct<qty int, price decimal(12,2)>>").alias("bulk_tiers"),
    )


def extract_table_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages (page_id, source_id, html) -> one row a table row of at least five cells.

    Columns: brand, sku, image, name, gross price, net price, stock.
    """
    rows = pages.select("page_id", "source_id", F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("pos", "tr"))
    cells = rows.withColumn("cells", F.regexp_extract_all("tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1)).where(F.size("cells") >= 5)
    text = lambda k: clean_text(strip_html(F.get("cells", F.lit(k))))
    image = F.get("cells", F.lit(2))
    attr = lambda name: F.nullif(F.regexp_extract(image, rf"""(?is)<img[^>]*\s{name}=["']([^"']*)["']""", 1), F.lit(""))
    named = cells.select("page_id", "source_id", "pos", text(0).alias("vendor"), split_ean_sku(text(1)).alias("code"), F.coalesce(attr("data-src"), attr("src"), F.lit("")).alias("image_url"),
        strip_box_note(text(3)).alias("name"), parse_price(text(4)).alias("gross"), parse_price(text(5)).alias("net"), text(6).alias("stock_text"), F.size("cells").alias("n"))
    sold_out = detect_out_of_stock(F.col("stock_text"))
    stock = F.when(F.col("n") > 6, F.when(sold_out, F.lit(0)).otherwise(F.regexp_replace("stock_text", "[^0-9]", "").try_cast("int")))
    out = named.select(
        "page_id",
        "source_id",
        "pos",
        compose_title(F.col("vendor"), F.col("name")).alias("raw_title"),
        "vendor",
        F.nullif("code.sku", F.lit("")).alias("sku"),
        validate_ean(F.col("code.barcode")).alias("barcode"),
        net_or_gross_price(F.col("net"), F.col("gross")).alias("price"),
        "image_url",
        stock.alias("stock"),
    )
    return out.where("raw_title <> ''").withColumn("available", F.coalesce(F.col("stock") != 0, F.lit(True)))
