"""speechframe: conversation analytics on Spark DataFrames."""
