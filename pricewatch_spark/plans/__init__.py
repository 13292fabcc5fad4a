"""Part of pricewatch_spark: plans."""
