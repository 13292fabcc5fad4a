"""Title normalisation as column expressions; one select, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewatch_spark import constants as K
from pricewatch_spark.functions.text import validate_ean
from pricewatch_spark.sources.tables import reliable

UNKNOWN = "Unknown"
ANSWER = "brand string, product_name string, variant string, fragrance_type string, ml int, gender string"
#: Confidence of an answer, by provider.
ANSWER_CONFIDENCE = {"groq": 0.90, "ollama": 0.75, "bedrock": 0.85}


def _ci(pattern: str) -> str:
    return f"(?iuU){pattern}"


def _literal(key: str) -> str:
    return r"\Q" + key + r"\E"


def brand_keys(brands: tuple[str, ...] = K.BRANDS) -> list[tuple[str, str]]:
    """(lower-case key, spelling), longest first; a key given again takes the later spelling but keeps its place."""
    found: dict[str, str] = {}
    for brand in brands:
        key = brand.lower()
        found[key] = brand
        plain = key.translate(str.maketrans("éôëè", "eoee"))
        if plain != key:
            found[plain] = brand
    return sorted(found.items(), key=lambda kv: -len(kv[0]))


def brand_from_vendor(vendor: Column) -> Column:
    """The longest key that lower(vendor) begins with, else the vendor itself; null if blank."""
    own = F.trim(vendor)
    lowered = F.lower(own)
    out = F.when(F.coalesce(own, F.lit("")) == "", F.lit(None).cast("string"))
    for key, brand in brand_keys():
        out = out.when(lowered.startswith(key), F.lit(brand))
    return out.otherwise(own)


def brand_from_title(title: Column) -> Column:
    """The longest key found between word boundaries; Unknown if there is none."""
    lowered = F.lower(title)
    any_key = "|".join(_literal(k) for k, _ in brand_keys())
    out = F.when(~F.coalesce(lowered.rlike(_ci(rf"\b(?:{any_key})\b")), F.lit(False)), F.lit(UNKNOWN))
    for key, brand in brand_keys():
        # contains is cheap and rules most keys out before the pattern is tried
        out = out.when(lowered.contains(key) & lowered.rlike(_ci(rf"\b{_literal(key)}\b")), F.lit(brand))
    return out.otherwise(F.lit(UNKNOWN))


def brand_table(brands: DataFrame, column: str = "brand", place: str | None = None) -> DataFrame:
    """(key, brand, size, place) of a list of brands of any length, one row a lower-case key.

    place, where the list has one, orders it: the last spelling of a key counts, at its first place; without one the
    largest spelling counts.  Blank and null brands are left out.
    """
    order = F.col(place) if place else F.lit(0)
    rows = brands.where(F.trim(F.coalesce(column, F.lit(""))) != "").select(F.lower(column).alias("key"), F.col(column).alias("brand"), order.cast("long").alias("place"))
    plain = rows.withColumn("key", F.translate("key", "éôëè", "eoee"))
    both = rows.withColumn("folded", F.lit(0)).unionByName(plain.join(rows.select("key", "brand"), ["key", "brand"], "left_anti").withColumn("folded", F.lit(1)))
    one = both.groupBy("key").agg(F.max_by("brand", F.struct("place", "folded", "brand")).alias("brand"), F.min(F.struct("place", "folded")).alias("place"))
    return one.withColumn("size", F.length("key"))


def brands_by_table(rows: DataFrame, column: str, table: DataFrame, of_vendor: bool = False) -> DataFrame:
    """rows with brand, found by joins to a brand_table: as brand_from_title does, or brand_from_vendor with of_vendor.

    For lists too long for one branch a brand.  Each distinct title is cut into its pieces between word boundaries (a
    vendor: into its beginnings) of the lengths that keys have; pieces meet the keys by a join, and the longest key
    wins, then the first in the list, then the largest.  Read ahead: the distinct lengths of keys, as many as the longest has characters.
    """
    sizes = sorted(r[0] for r in table.select("size").distinct().collect())
    own = F.trim(column) if of_vendor else F.col(column)
    names = rows.select(F.col(column).alias("name")).where("name is not null").distinct().withColumn("low", F.lower(F.trim("name") if of_vendor else F.col("name")))
    lengths = F.array(*(F.lit(n) for n in sizes)).cast("array<int>")
    if of_vendor:
        pieces = F.transform(F.filter(lengths, lambda n: n <= F.length("low")), lambda n: F.substring(F.col("low"), F.lit(1), n))
    else:
        word = F.transform(F.split("low", ""), lambda c: c.rlike(r"(?U)\w"))
        edges = F.filter(F.sequence(F.lit(0), F.length("low")), lambda i: F.coalesce(F.get(F.col("word"), i - 1), F.lit(False)) != F.coalesce(F.get(F.col("word"), i), F.lit(False)))
        names = names.withColumn("word", word).withColumn("edges", edges)
        ends = lambda i: F.filter(lengths, lambda n: F.array_contains(F.col("edges"), i + n))
        pieces = F.flatten(F.transform("edges", lambda i: F.transform(ends(i), lambda n: F.substring(F.col("low"), i + 1, n))))
    asked = names.select("name", F.explode(F.array_distinct(pieces)).alias("key"))
    found = asked.join(table, "key").groupBy("name").agg(F.max_by("brand", F.struct("size", -F.col("place.place"), -F.col("place.folded"), "brand")).alias("_brand"))
    told = rows.join(found.withColumnRenamed("name", "_name"), F.col(column) == F.col("_name"), "left").drop("_name")
    blank = F.when(F.coalesce(own, F.lit("")) == "", F.lit(None).cast("string")).otherwise(own) if of_vendor else F.lit(UNKNOWN)
    return told.withColumn("brand", F.coalesce("_brand", blank)).drop("_brand")


def extract_ml(title: Column) -> Column:
    ml = F.regexp_extract(title, _ci(K.VOLUME), 1).try_cast("int")
    return F.when(ml.between(1, 10000), ml)


def _first_match(c: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    out = None
    for name, pattern in patterns:
        hit = c.rlike(_ci(pattern))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def extract_fragrance_type(c: Column) -> Column:
    return _first_match(c, K.TYPE_PATTERNS)


def extract_gender(c: Column) -> Column:
    return _first_match(c, K.GENDER_PATTERNS)


def extract_product_name(title: Column, brand: Column) -> Column:
    """What is left of the title without brand prefix, volume, type and gender words; null below 2 characters."""
    has_prefix = (brand != UNKNOWN) & F.lower(title).startswith(F.lower(brand))
    rest = F.when(has_prefix, F.regexp_replace(F.substring(title, F.length(brand) + 1, F.lit(1 << 30)), r"^(?U)\s*[-–]?\s*", "")).otherwise(title)
    rest = F.regexp_replace(rest, _ci(K.VOLUME), "")
    for _, pattern in (*K.TYPE_PATTERNS, *K.GENDER_PATTERNS):
        rest = F.regexp_replace(rest, _ci(pattern), "")
    rest = F.regexp_replace(rest, r"[\(\)\[\]\-–_]+", " ")
    rest = F.trim(F.regexp_replace(rest, r"(?U)\s+", " "))
    return F.when(F.length(rest) >= 2, rest)


def extract_variant(name: Column) -> Column:
    found = [F.regexp_extract(name, _ci(p), 1) for p in K.VARIANT_PATTERNS]
    return F.coalesce(*(F.when(x != "", x) for x in found))


def confidence(brand: Column, name: Column, fragrance_type: Column, ml: Column) -> Column:
    hits = [brand != UNKNOWN, name.isNotNull(), fragrance_type.isNotNull(), ml.isNotNull()]
    return (sum((F.coalesce(h, F.lit(False)).cast("int") for h in hits[1:]), F.coalesce(hits[0], F.lit(False)).cast("int")) / 4).cast("decimal(3,2)")


def normalize_titles(raw: DataFrame) -> DataFrame:
    """raw (raw_title, vendor, tags, barcode, ...) with brand, volume_ml, fragrance_type, gender,
    ean_13, product_name, variant, confidence_score, normalization_method added.

    Intermediate columns are named stage by stage, so a long expression is evaluated once.
    """
    title = F.coalesce("raw_title", F.lit(""))
    combined = F.trim(F.concat_ws(" ", title, F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))
    first = raw.withColumns(
        {
            "brand": F.coalesce(brand_from_vendor(F.col("vendor")), brand_from_title(title)),
            "volume_ml": extract_ml(title),
            "fragrance_type": extract_fragrance_type(combined),
            "gender": extract_gender(combined),
            "ean_13": validate_ean(F.col("barcode")),
        }
    )
    named = first.withColumn("clean_name", extract_product_name(title, F.col("brand")))
    return named.withColumns(
        {
            "product_name": F.coalesce("clean_name", F.substring(title, 1, 100)),
            "variant": extract_variant(F.col("clean_name")),
            "confidence_score": confidence(F.col("brand"), F.col("clean_name"), F.col("fragrance_type"), F.col("volume_ml")),
            "normalization_method": F.lit("REGEX"),
        }
    ).drop("clean_name")


def route_llm(norm: DataFrame, description: str = "description", most: int = 300) -> DataFrame:
    """needs_llm, hints and a prompt; rows with every field at full confidence need no call."""
    hints = F.create_map(
        F.lit("brand"), F.when(F.col("brand") != UNKNOWN, F.col("brand")),
        F.lit("ml"), F.col("volume_ml").cast("string"),
        F.lit("fragrance_type"), F.col("fragrance_type"),
        F.lit("gender"), F.col("gender"),
    )
    known = F.map_filter(hints, lambda _, v: v.isNotNull())
    prompt = F.concat(
        F.lit("Title: "), F.coalesce("raw_title", F.lit("")),
        F.lit("\nDescription: "), F.substring(F.coalesce(F.col(description), F.lit("")), 1, most),
        F.lit("\nKnown: "), F.to_json(known),
        F.lit("\nAnswer with JSON: brand, product_name, variant, fragrance_type, ml, gender."),
    )
    needed = F.col("confidence_score") < 0.85
    return norm.withColumns({"needs_llm": needed, "hints": known, "prompt": F.when(needed, prompt)})


def parse_llm_response(c: Column) -> Column:
    """The JSON between the first { and the last }, code fences dropped; null if there is none."""
    body = F.regexp_extract(F.regexp_replace(c, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(body != "", body), ANSWER)


def merge_llm(rule: DataFrame, answers: DataFrame, key: str = "row_id", provider: str = "groq") -> DataFrame:
    """answers (key, answer struct): hints and rule fields win, except for the product name."""
    best = F.lit(ANSWER_CONFIDENCE[provider]).cast("decimal(3,2)")
    own = answers.select(key, "answer")
    joined = rule.join(own, key, "left")
    got = F.col("answer").isNotNull()
    pick = lambda mine, theirs: F.when(got, F.coalesce(mine, theirs)).otherwise(mine)
    return joined.withColumns(
        {
            "brand": pick(F.when(F.col("brand") != UNKNOWN, F.col("brand")), F.coalesce("answer.brand", F.lit(UNKNOWN))),
            "product_name": F.when(got, F.coalesce("answer.product_name", "product_name")).otherwise(F.col("product_name")),
            "variant": pick(F.col("variant"), F.col("answer.variant")),
            "fragrance_type": pick(F.col("fragrance_type"), F.col("answer.fragrance_type")),
            "volume_ml": pick(F.col("volume_ml"), F.col("answer.ml")),
            "gender": pick(F.col("gender"), F.col("answer.gender")),
            "confidence_score": F.when(got, F.greatest("confidence_score", best)).otherwise(F.col("confidence_score")),
            "normalization_method": F.when(got, F.lit("HYBRID")).otherwise(F.col("normalization_method")),
        }
    ).withColumn("brand", F.coalesce("brand", F.lit(UNKNOWN))).drop("answer")


def enrich(df: DataFrame, functions: list[Callable[[str], str | None]], key: str = "row_id", partitions: int | None = None) -> DataFrame:
    """key, response: the first of the functions that answers a prompt; only rows that need a call are sent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for prompt in batch["prompt"]:
                answer = None
                for f in functions:
                    try:
                        answer = f(prompt)
                    except Exception:  # a provider that fails gives way to the next
                        answer = None
                    if answer:
                        break
                out.append(answer)
            yield pd.DataFrame({key: batch[key], "response": out})

    # kept first: a call costs more than a write, and the prompt's long expression stays out of the filter
    asked = reliable(df.select(key, "needs_llm", "prompt")).where("needs_llm").select(key, "prompt")
    asked = asked.repartition(partitions) if partitions else asked
    return asked.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, response string")


def split_non_perfume(norm: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = F.col("volume_ml").isNotNull() & F.col("fragrance_type").isNotNull()
    return norm.where(good), norm.where(~good)


def infer_category(brand: Column, tags: Column) -> Column:
    own = F.trim(F.lower(brand))
    lowered = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    tagged = lambda words: F.arrays_overlap(lowered, F.array(*map(F.lit, words)))
    return (
        F.when(own.isin(*K.NICHE), "niche")
        .when(own.isin(*K.ARABIC), "arabic")
        .when(own.isin(*K.DESIGNER), "designer")
        .when(tagged(K.NICHE_TAGS), "niche")
        .when(tagged(K.ARABIC_TAGS), "arabic")
        .when(tagged(K.CELEBRITY_TAGS), "celebrity")
        .when(own != "", "designer")
    )


def normalization_accuracy(pred: DataFrame, truth: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows, rows with brand (any case), type and volume all right, their share, share of LLM calls."""
    right = (F.lower("brand") == F.lower("expected_brand")) & F.col("fragrance_type").eqNullSafe(F.col("expected_type")) & F.col("volume_ml").eqNullSafe(F.col("expected_ml"))
    return pred.join(truth, key).agg(
        F.count(F.lit(1)).alias("titles"),
        F.count_if(right).alias("right"),
        (F.count_if(right) / F.count(F.lit(1))).alias("accuracy"),
        (F.count_if(F.col("confidence_score") < 0.85) / F.count(F.lit(1))).alias("llm_share"),
    )


