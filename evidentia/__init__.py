"""Evidence-memory analytics on Spark: append-only logs, derived views and retrieval over DataFrames."""
