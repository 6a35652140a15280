"""Table operators: every one takes DataFrames and column names and returns a DataFrame."""
