"""Co-variation analytics over aligned categorical sequences, on Spark DataFrames."""
