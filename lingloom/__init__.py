"""lingloom: corpus linking, scoring and reporting on Spark DataFrames."""
