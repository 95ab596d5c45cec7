"""querylens: search-relevance analytics and corpus preparation on Spark DataFrames."""
