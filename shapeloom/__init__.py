"""Query-shape analytics for search workloads, on Spark DataFrames."""
