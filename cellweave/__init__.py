"""cellweave: relational, graph and higher-order (topological) analytics on PySpark DataFrames."""
