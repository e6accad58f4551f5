"""pagelens: website evidence and corpus preparation on Spark DataFrames."""
