"""Part of pricewatch_spark: operators."""
