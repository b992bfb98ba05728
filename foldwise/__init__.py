"""foldwise: differential enrichment and per-feature modelling on Spark DataFrames."""
