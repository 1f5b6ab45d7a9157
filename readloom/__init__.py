"""Read demultiplexing and quality analytics on Spark DataFrames."""
