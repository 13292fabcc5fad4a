"""Canonical products: matching, numbering, enrichment, search, purge."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewatch_spark.sources.tables import reliable

CODES_A_PREFIX = 99_999_999
#: Weights of the search fields, A to D.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
STOP_WORDS = ("de", "la", "el", "los", "las", "y", "para", "con", "en", "un", "una", "por", "del", "al")
IDENTITY = ["brand", "product_name", "volume_ml", "variant"]


def match_by_ean(rows: DataFrame, products: DataFrame) -> DataFrame:
    """rows with ean_code: the smallest code of a product that stores the row's barcode."""
    known = products.where("ean_13 is not null").groupBy("ean_13").agg(F.min("product_code").alias("ean_code"))
    return rows.join(known, "ean_13", "left")


def match_by_identity(rows: DataFrame, products: DataFrame) -> DataFrame:
    """rows with identity_code; the concentration is not part of the identity."""
    known = products.groupBy(identity_key().alias("_identity")).agg(F.min("product_code").alias("identity_code"))
    return rows.withColumn("_identity", identity_key()).join(known, "_identity", "left").drop("_identity")


def match_products(rows: DataFrame, products: DataFrame) -> DataFrame:
    """product_code: by barcode, else by identity, else null (a new product)."""
    both = match_by_identity(match_by_ean(rows, products), products)
    method = F.when(F.col("ean_code").isNotNull(), "EAN").when(F.col("identity_code").isNotNull(), "IDENTITY").otherwise("NEW")
    return both.withColumn("product_code", F.coalesce("ean_code", "identity_code")).withColumn("matched_by", method).drop("ean_code", "identity_code")


def identity_key() -> Column:
    part = lambda c: F.coalesce(F.lower(F.col(c).cast("string")), F.lit("\u0000"))
    return F.sha2(F.concat_ws("\u0001", *(part(c) for c in IDENTITY)), 256)


def barcode_owners(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = reliable) -> DataFrame:
    """edges (ean_13, identity, at) -> those at which a product takes its barcode.

    In the order of at, a row gives its barcode to the product of its identity if neither has one yet.
    An edge that is the first both of its barcode and of its identity, among the edges left, is taken
    whatever else happens; all such edges are taken at once, what they settle is left out, and so on.
    Each round is two aggregations of one row a barcode and one an identity: a barcode that very many
    identities share, or the reverse, is settled in one round and never comes together in a task.
    """
    taken = []
    left = keep(edges)
    while not left.isEmpty():
        first_of = left.groupBy("ean_13").agg(F.min(F.struct("at", "identity")).alias("e")).select("ean_13", "e.identity", "e.at")
        first_for = left.groupBy("identity").agg(F.min(F.struct("at", "ean_13")).alias("i")).select("i.ean_13", "identity")
        now = keep(first_of.join(first_for, ["ean_13", "identity"]))
        taken.append(now)
        left = keep(left.join(now.select("ean_13"), "ean_13", "left_anti").join(now.select("identity"), "identity", "left_anti"))
    return reduce(DataFrame.unionByName, taken) if taken else edges.limit(0)


def resolve_products(rows: DataFrame, products: DataFrame, *order: str, keep: Callable[[DataFrame], DataFrame] = reliable) -> DataFrame:
    """rows with product_code (a known product) or group_key (equal for rows of one new product), as if
    rows came one after the other: each matches by barcode, else by identity, else creates a product,
    and a product without a barcode takes that of the next row that it is given.

    order must tell all rows apart.  keep: how what is read again is materialised.
    """
    at = F.struct(*order)
    by_ean = products.where("ean_13 is not null").groupBy("ean_13").agg(F.min("product_code").alias("ean_code"))
    of = F.min_by(F.struct(F.col("product_code").alias("code"), F.col("ean_13").isNotNull().alias("has_ean")), "product_code")
    by_identity = products.groupBy(identity_key().alias("identity")).agg(of.alias("own"))
    known = keep(rows.withColumn("identity", identity_key()).join(by_ean, "ean_13", "left").join(by_identity, "identity", "left"))
    free = F.col("ean_13").isNotNull() & F.col("ean_code").isNull() & ~F.coalesce("own.has_ean", F.lit(False))
    owners = barcode_owners(known.where(free).groupBy("ean_13", "identity").agg(F.min(at).alias("at")), keep)
    owners = owners.join(by_identity.select("identity", F.col("own.code").alias("owner_code")), "identity", "left").select("ean_13", F.col("identity").alias("owner"), "owner_code", F.col("at").alias("since"))
    owned = F.col("since").isNotNull() & (at >= F.col("since"))
    code = F.coalesce("ean_code", F.when(owned, F.col("owner_code")).otherwise(F.col("own.code")))
    found = known.join(owners, "ean_13", "left").withColumn("product_code", code)
    found = found.withColumn("group_key", F.when(F.col("product_code").isNull(), F.when(owned, F.col("owner")).otherwise(F.col("identity"))))
    return found.drop("identity", "own", "ean_code", "owner", "owner_code", "since")


def group_new_products(rows: DataFrame, mode: str = "leader") -> DataFrame:
    """rows (pos, ean_13, identity fields) with group_key: rows of one new product.

    leader: rows share the identity of the first row with their barcode.  exact: as one row after the
    other would create and match products.
    """
    if mode == "exact":
        nothing = rows.sparkSession.createDataFrame([], "product_code string, ean_13 string, brand string, product_name string, volume_ml int, variant string")
        return resolve_products(rows, nothing, "pos").drop("product_code")
    keyed = rows.withColumn("identity", identity_key())
    leaders = keyed.where("ean_13 is not null").groupBy("ean_13").agg(F.min_by("identity", "pos").alias("leader"))
    return keyed.join(leaders, "ean_13", "left").withColumn("group_key", F.coalesce("leader", "identity")).drop("leader", "identity")


def enrich_products(products: DataFrame, rows: DataFrame) -> DataFrame:
    """Null type, volume, gender, barcode and name filled from the first row that has them."""
    fields = ["fragrance_type", "volume_ml", "gender", "ean_13", "normalized_name"]
    first = rows.groupBy("product_code").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(f"new_{c}") for c in fields))
    joined = products.join(first, "product_code", "left")
    return joined.withColumns({c: F.coalesce(c, f"new_{c}") for c in fields}).drop(*(f"new_{c}" for c in fields))


def parse_code(c: Column) -> Column:
    """struct(prefix, number, ordinal); null if the code isn't letters and 8 digits."""
    prefix = F.regexp_extract(c, r"^([a-z]+)(\d{8})$", 1)
    number = F.regexp_extract(c, r"^([a-z]+)(\d{8})$", 2).try_cast("long")
    letters = F.transform(F.split(prefix, ""), lambda x: F.ascii(x) - 96)
    index = F.aggregate(letters, F.lit(0).cast("long"), lambda acc, x: acc * 26 + x) - 1
    return F.when(prefix != "", F.struct(prefix.alias("prefix"), number.alias("number"), (index * CODES_A_PREFIX + number).alias("ordinal")))


def code_of(ordinal: Column) -> Column:
    """The code with that ordinal: 1 is a00000001; prefixes run a..z, aa..az, ba.."""
    zero = (ordinal - 1).cast("long")
    index = F.floor(zero / CODES_A_PREFIX)
    number = zero % CODES_A_PREFIX + 1
    # up to five letters: bijective base 26
    letters, rest, out = [], index + 1, F.lit("")
    for _ in range(5):
        digit = F.when(rest > 0, (rest - 1) % 26)
        letters.append(F.when(digit.isNotNull(), F.char((digit + 97).cast("int"))).otherwise(F.lit("")))
        rest = F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(F.lit(0))
    for x in letters:
        out = F.concat(x, out)
    return F.concat(out, F.lpad(number.cast("string"), 8, "0"))


def largest_ordinal(products: DataFrame) -> int:
    """The largest ordinal in use; fallback codes (emrg) don't count."""
    codes = products.where(~F.col("product_code").startswith("emrg")).select(parse_code(F.col("product_code")).alias("p"))
    return int(codes.agg(F.coalesce(F.max("p.ordinal"), F.lit(0))).first()[0])


def number_rows(df: DataFrame, *order: str) -> DataFrame:
    """df with ordinal 1, 2, ... in the given order, without one window over all rows.

    Rows are ranged by the order and kept in the checkpoint folder with their partition, so that the
    counts and the numbers are of the same partitions; only the counts (one a partition) are summed up.
    """
    ranged = reliable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_within", within).join(F.broadcast(offsets), "_part").withColumn("ordinal", (F.col("_before") + F.col("_within")).cast("long")).drop("_part", "_within", "_before")


def assign_codes(new: DataFrame, products: DataFrame, *order: str) -> DataFrame:
    base = largest_ordinal(products)
    return number_rows(new, *order).withColumn("product_code", code_of(F.col("ordinal") + base)).drop("ordinal")


def fallback_code(key: Column) -> Column:
    number = F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 10), 16, 10).cast("decimal(20,0)"), F.lit(CODES_A_PREFIX))
    return F.concat(F.lit("emrg"), F.lpad(number.cast("string"), 8, "0"))


def tokens(c: Column) -> Column:
    plain = F.translate(F.lower(F.coalesce(c, F.lit(""))), "áéíóúüñàèìòùâêîôûç", "aeiouunaeiouaeiouc")
    words = F.split(F.regexp_replace(plain, "[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def search_index(products: DataFrame) -> DataFrame:
    """product_code, token, weight: brand and name A, variant B, type and volume C."""
    fields = {"brand": "A", "product_name": "A", "variant": "B", "fragrance_type": "C", "volume_ml": "C"}
    entry = lambda name, grade: F.transform(tokens(F.col(name).cast("string")), lambda t: F.struct(t.alias("token"), F.lit(WEIGHTS[grade]).alias("weight")))
    every = F.concat(*(entry(n, g) for n, g in fields.items()))
    return products.select("product_code", F.explode(every).alias("e")).groupBy("product_code", "e.token").agg(F.max("e.weight").alias("weight"))


def search(index: DataFrame, terms: str, k: int = 20) -> DataFrame:
    """The k products of the largest weight that hold every term."""
    wanted = index.sparkSession.range(1).select(F.explode(F.array_distinct(tokens(F.lit(terms)))).alias("token"))
    needed = F.lit(1)
    hits = index.join(F.broadcast(wanted), "token").groupBy("product_code").agg(F.sum("weight").alias("score"), F.count(needed).alias("n"))
    total = wanted.agg(F.count(needed).alias("total"))
    return hits.join(F.broadcast(total), F.col("n") == F.col("total")).select("product_code", "score").orderBy(F.desc("score"), "product_code").limit(k)


def purge(products: DataFrame, listings: DataFrame, history: DataFrame, sources: DataFrame, source_pattern: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without products that lack volume or type and without sources by name, down to the history."""
    kept = products.where("volume_ml is not null and fragrance_type is not null")
    out_sources = sources.where(F.col("name").like(source_pattern)).select("source_id")
    kept_listings = listings.join(kept.select("product_id"), "product_id", "left_semi").join(out_sources, "source_id", "left_anti")
    return kept, kept_listings, history.join(kept_listings.select("listing_id"), "listing_id", "left_semi")
