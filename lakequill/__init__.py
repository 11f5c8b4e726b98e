"""lakequill: an entity-query engine and data toolkit on Spark DataFrames."""
