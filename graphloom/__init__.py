"""Learning from networked data and multivariate time series, on Spark DataFrames."""
