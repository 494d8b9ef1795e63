"""Ways to get `files` and `records` DataFrames."""
