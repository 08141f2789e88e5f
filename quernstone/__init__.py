"""A property-graph and search engine over Spark DataFrames."""
