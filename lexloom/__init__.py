"""lexloom: document analytics on Spark, as DataFrame, SQL and window operations."""
