"""Analytics for long-document text-recognition benchmarks, on Spark DataFrames."""
