"""Set-based price-intelligence jobs on Spark."""
