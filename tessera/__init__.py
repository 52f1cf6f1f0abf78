"""tessera: a columnar analytics engine on Spark DataFrames."""
