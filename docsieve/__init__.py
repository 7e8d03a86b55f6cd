"""docsieve: set-based document analytics on Spark DataFrames."""
