"""Part of pricewatch_spark: sources."""
