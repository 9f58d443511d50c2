"""trelliq: relational-to-graph analytics on Spark DataFrames."""
