"""cairnbook: document, bookkeeping and training-data analytics on Spark DataFrames."""
