"""Part of pricewatch_spark: streaming."""
