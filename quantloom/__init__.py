"""Cross-sectional panel analytics on Spark DataFrames."""
