"""One run of raw listings, as one job: from observed rows to products, listings, history and counters."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewatch_spark.functions import titles
from pricewatch_spark.functions.text import variant_signature
from pricewatch_spark.operators import delta, products
from pricewatch_spark.operators.delta import KEY
from pricewatch_spark.sources.tables import Scratch

#: Rows come one after the other in this order.
ORDER = ("scraped_at", "pos", *KEY)
IDENTITY_FACTS = ("brand", "product_name", "variant", "volume_ml", "fragrance_type", "gender", "ean_13", "normalization_method", "confidence_score", "category")
TITLED = ("raw_title", "vendor", "tags", "barcode")
#: What a listing has besides its state.
CARRIED = ("product_code", "variant_signature")
PRODUCTS = "product_code string, brand string, product_name string, variant string, volume_ml int, fragrance_type string, gender string, ean_13 string, normalization_method string, confidence_score decimal(3,2), category string, normalized_name string"


class Ingested(NamedTuple):
    """What a run leaves behind; all five read one materialised batch, kept until it is cleared."""

    products: DataFrame
    listings: DataFrame
    history: DataFrame
    counters: DataFrame
    rejects: DataFrame
    kept: Scratch


def first_rows(fresh: DataFrame) -> DataFrame:
    """Of each listing that is new in the batch its first row that is a perfume: key, order and identity.

    Of other rows volume and type alone are told.
    """
    good, _ = titles.split_non_perfume(titles.normalize_titles(fresh.select(*ORDER, *TITLED)))
    first = good.groupBy(*KEY).agg(F.min_by(F.struct("scraped_at", "pos", *TITLED), F.struct("scraped_at", "pos")).alias("f")).select(*KEY, "f.*")
    return titles.normalize_titles(first).withColumn("category", titles.infer_category(F.col("brand"), F.col("tags"))).select(*ORDER, *IDENTITY_FACTS)


def created_products(placed: DataFrame, known: DataFrame) -> DataFrame:
    """placed rows without product_code -> a product a group_key, numbered in the order of their first rows;
    type, volume, gender and barcode come from the first row of the group that has them."""
    at = F.struct(*ORDER)
    filled = ("fragrance_type", "volume_ml", "gender", "ean_13")
    taken = [c for c in IDENTITY_FACTS if c not in filled]
    new = placed.where("product_code is null").groupBy("group_key").agg(
        F.min_by(F.struct(*ORDER, *taken), at).alias("f"), *(F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in filled)
    )
    return products.assign_codes(new.select("group_key", "f.*", *filled).withColumn("normalized_name", F.trim(F.lower("product_name"))), known, *ORDER)


def one_listing_a_signature(placed: DataFrame, snapshot: DataFrame) -> DataFrame:
    """placed new listings with merged_id: the external id of the listing that already has their product,
    source and signature, in the snapshot or earlier in the batch."""
    by = ["product_code", "source_id", "variant_signature"]
    known = snapshot.where("product_code is not null and variant_signature is not null").groupBy(*by).agg(F.min("source_external_id").alias("known_id"))
    first = placed.groupBy(*by).agg(F.min_by("source_external_id", F.struct(*ORDER)).alias("first_id"))
    return placed.join(first.join(known, by, "left"), by).withColumn("merged_id", F.coalesce("known_id", "first_id")).drop("known_id", "first_id")


def ingest(raw: DataFrame, sources: DataFrame, known: DataFrame, snapshot: DataFrame, as_of: Column | None = None, silent_minutes: int = 1440, once: bool = True) -> Ingested:
    """A run of raw listings against the known products and the snapshot of listings.

    Rows of listings that the snapshot has are compared with their state alone.  Of others, titles are
    normalised; rows before the first that is a perfume fail, and that one is matched (by barcode, by
    identity) or creates a product, in the order of rows.  A new external id whose product, source and
    signature have a listing already is that listing for the rest of the run: its rows join the listing's
    chain of states, and equal states count as unchanged there.  as_of delists listings that were silent before it.

    The batch is materialised once with its facts, dealt by listing; listing, product and signature are
    joined by keys, nothing but the number of the last product code comes to the driver.  The changes are
    materialised too, dealt alike; with once=False they aren't, for a caller that reads one of the
    outputs alone: it deals only what that output needs.  sources, a row a shop, is broadcast.
    """
    kept = Scratch(raw.sparkSession)
    observed = delta.observe(raw, F.broadcast(sources))
    is_known = snapshot.select(*KEY, F.lit(True).alias("listed"))
    observed = kept.deal(observed.select(*ORDER, "run_id", *delta.FACTS, *TITLED[1:]), *KEY).join(is_known, KEY, "left").withColumn("fresh", F.col("listed").isNull()).drop("listed")
    observed = kept.keep(observed, *KEY)
    placed = products.resolve_products(first_rows(observed.where("fresh").where(~delta.spoilt())), known, *ORDER, keep=kept.keep)
    new = kept.keep(created_products(placed, known))
    placed = placed.join(new.select("group_key", F.col("product_code").alias("new_code")), "group_key", "left")
    placed = placed.withColumns({"product_code": F.coalesce("product_code", "new_code"), "variant_signature": variant_signature(F.col("volume_ml"), F.col("fragrance_type"))})
    placed = kept.keep(placed)
    merged = kept.keep(one_listing_a_signature(placed, snapshot).select(*KEY, "scraped_at", "pos", "merged_id", *CARRIED))
    kept.clear(observed, new, placed, merged)

    starts = merged.select(*KEY, F.struct("scraped_at", "pos").alias("start"), "merged_id")
    rows = observed.drop("vendor", "tags", "barcode").join(starts, KEY, "left")
    early = F.col("start").isNull() | (F.struct("scraped_at", "pos") < F.col("start"))
    rows = rows.withColumns({"rejected": F.col("fresh") & early, "source_external_id": F.coalesce("merged_id", "source_external_id")})
    changes = delta.classify_changes(rows.drop("start", "merged_id", "fresh"), snapshot)
    if once:
        changes = kept.keep(changes, *KEY)
        kept.clear(changes, new, placed, merged)

    listings = delta.next_snapshot(changes, snapshot)
    # what a listing carries is what it has in the snapshot, else what its own first row was given
    carried = snapshot.select(*KEY, *CARRIED).unionByName(merged.where(F.col("merged_id") == F.col("source_external_id")).select(*KEY, *CARRIED))
    listings = listings.join(carried, KEY, "left")
    if as_of is not None:
        listings = delta.delist_stale(listings, as_of, silent_minutes)
    seen = placed.where("new_code is null").withColumns({"pos": F.struct(*ORDER), "normalized_name": F.trim(F.lower("product_name"))})
    grown = products.enrich_products(known, seen).unionByName(new.select(*(c for c in known.columns if c in new.columns)), allowMissingColumns=True)
    rejects = changes.where("change = 'failed'").select(*KEY, "scraped_at", "pos", "raw_title", F.when(delta.spoilt(), "SPOILT").otherwise("NO_PERFUME").alias("reason"))
    return Ingested(grown, listings, delta.history_rows(changes), delta.run_counters(changes), rejects, kept)
