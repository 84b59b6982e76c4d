"""Knowledge analytics over time and space on Spark DataFrames."""
