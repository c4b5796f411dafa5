"""Set-at-a-time code-audit analytics on Spark DataFrames."""
