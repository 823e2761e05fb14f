"""complyspark: a document-compliance analytics engine on Spark DataFrames."""
