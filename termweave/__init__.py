"""Dictionary-based concept recognition over Spark DataFrames."""
