"""lodestone: vector and text retrieval over Spark DataFrames."""
