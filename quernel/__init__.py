"""quernel: reactive document collections on Spark DataFrames."""
