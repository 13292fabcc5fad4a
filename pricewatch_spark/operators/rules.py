"""Constraints as data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewatch_spark import constants as K
from pricewatch_spark.functions.text import transition_ok


def blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


#: rule name -> condition that a row breaks; null conditions are not broken.
PRODUCT_RULES: dict[str, Column | str] = {
    "brand_blank": "trim(coalesce(brand, '')) = ''",
    "name_blank": "trim(coalesce(product_name, '')) = ''",
    "code_format": "not product_code rlike '^[a-z]+[0-9]{8}$'",
    "ean_format": "not ean_13 rlike '^[0-9]{12,13}$'",
    "confidence_range": "confidence < 0 or confidence > 1",
    "volume_positive": "volume_ml <= 0",
    "type_enum": f"fragrance_type not in {K.FRAGRANCE_TYPES}",
}
LISTING_RULES: dict[str, Column | str] = {
    "price_negative": "current_price < 0",
    "stock_negative": "current_stock < 0",
    "availability_enum": f"availability not in {K.AVAILABILITY}",
    "confidence_enum": f"stock_confidence not in {K.STOCK_CONFIDENCE}",
}
HISTORY_RULES: dict[str, Column | str] = {"price_null": "price is null", "price_negative": "price < 0", "stock_negative": "stock < 0", "availability_enum": f"availability not in {K.AVAILABILITY}"}
TIER_RULES: dict[str, Column | str] = {"price_negative": "price < 0", "tier_name_blank": "trim(coalesce(tier_name, '')) = ''"}
LOG_RULES: dict[str, Column | str] = {f"{c}_negative": f"{c} < 0" for c in ("records_extracted", "records_updated", "records_skipped", "records_failed")}
#: The lengths that columns of a listing may have.
LENGTHS = {"source_external_id": 255, "title": 500, "url": 1024, "image_url": 1024, "current_hash": 64, "tier_name": 100}
QUEUE_RULES: dict[str, Column | str] = {"priority_range": "priority < 1 or priority > 10", "status_enum": f"status not in {K.STATUSES}", "retries_negative": "retries < 0"}


def length_rules(df: DataFrame) -> dict[str, str]:
    """A rule for each column of df whose length is bounded."""
    return {f"{c}_length": f"length({c}) > {most}" for c, most in LENGTHS.items() if c in df.columns}


def row_violations(df: DataFrame, rules: dict[str, Column | str]) -> DataFrame:
    """df with violations: the names of the rules that a row breaks."""
    broken = [F.when(F.expr(c) if isinstance(c, str) else c, F.lit(name)) for name, c in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def violation_counts(df: DataFrame, rules: dict[str, Column | str]) -> DataFrame:
    """rule, rows: how many rows break each rule that is broken at all."""
    return row_violations(df, rules).select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


def duplicate_keys(df: DataFrame, keys: list[str], nulls_equal: bool = True) -> DataFrame:
    rows = df if nulls_equal else df.dropna(subset=keys)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows whose non-null key has no parent."""
    known = parent.select(F.col(parent_key or key).alias(key))
    return child.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def low_confidence(products: DataFrame, below: float = 0.80) -> DataFrame:
    return products.where(F.col("confidence") < below).orderBy("confidence", "product_code")


def illegal_transitions(history: DataFrame, key: list[str], at: list[str], state: str = "availability") -> DataFrame:
    before = F.lag(state).over(Window.partitionBy(*key).orderBy(*at))
    return history.withColumn("prev_state", before).where(~transition_ok(F.col("prev_state"), F.col(state)))
