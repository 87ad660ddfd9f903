"""textloom: measuring prose at corpus scale on Spark DataFrames."""
