"""Search, metrics and corpus operators on PySpark DataFrames."""
