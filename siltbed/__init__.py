"""Archive-metadata analytics as Spark DataFrames."""
