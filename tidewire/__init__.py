"""Company-news and market-price analytics on PySpark DataFrames."""
