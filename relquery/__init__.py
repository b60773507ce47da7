"""relquery: relational queries with nested relations, built on Spark DataFrames."""
