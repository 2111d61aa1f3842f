"""sketchmeans: K-means of large tables of vectors, dense or on a random sketch, as Spark DataFrames."""

__version__ = "2.1.0"
