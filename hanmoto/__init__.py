"""Analytics over inline-annotated Japanese book text, built on Spark DataFrames."""
