"""weftgraph: governed knowledge graphs as Spark DataFrames."""
