"""Part of pricewatch_spark: functions."""
