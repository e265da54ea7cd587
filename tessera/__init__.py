"""tessera: a semantic layer of measures over Spark DataFrames."""
