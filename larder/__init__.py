"""larder: explainable product-label analytics on Spark DataFrames."""
