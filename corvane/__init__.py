"""Analytics over corpora of papers, as lazy Spark DataFrames."""
