"""loreweave: retrieval, entity-graph and corpus analytics written for Spark DataFrames."""
