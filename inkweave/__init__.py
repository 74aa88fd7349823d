"""Site-to-Markdown corpus engine expressed as Spark DataFrames."""
