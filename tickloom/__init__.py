"""tickloom: market-microstructure analytics on Spark DataFrames."""
