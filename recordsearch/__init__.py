"""Search and upkeep of public-record documents on Spark DataFrames."""
