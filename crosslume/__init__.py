"""Night-time crosswalk lighting analytics on Spark DataFrames."""
