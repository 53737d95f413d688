"""Archive and genealogy research analytics on Spark DataFrames."""
