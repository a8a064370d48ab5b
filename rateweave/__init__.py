"""rateweave: hybrid rating prediction on Spark DataFrames."""
