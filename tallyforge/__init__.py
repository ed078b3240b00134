"""Contest analytics on PySpark: every operator takes DataFrames and returns a DataFrame."""
