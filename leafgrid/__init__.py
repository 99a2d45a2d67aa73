"""Document-layout analytics on PySpark DataFrames."""
