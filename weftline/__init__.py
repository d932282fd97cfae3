"""weftline: run-history and dependency-graph analytics as Spark DataFrames."""
