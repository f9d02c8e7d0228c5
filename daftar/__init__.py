"""daftar: document-date analytics on Spark DataFrames."""
