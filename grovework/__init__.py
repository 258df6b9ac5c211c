"""grovework: hierarchical text retrieval and corpus preparation on Spark DataFrames."""
