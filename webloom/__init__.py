"""webloom: site-wide content and link-graph analytics on Spark DataFrames."""
