"""Option open-interest analytics on Spark: ingestion, merges, daily features and views."""
