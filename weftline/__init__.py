"""Co-occurrence, coverage and text-corpus analytics on Spark DataFrames."""
