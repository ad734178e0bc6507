"""Panel, demography and report tables as Spark DataFrames."""
