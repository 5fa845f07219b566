"""codeloom: structural queries over code-graph indexes, as Spark DataFrames."""
