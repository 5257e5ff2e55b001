"""Decision-log analytics and corpus processing on Spark."""
