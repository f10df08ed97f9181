"""sparkfold: content analytics, redundancy search and lossless encoding on Spark DataFrames."""
