"""Source audits on Spark: sources x rules -> findings -> reports, as DataFrames."""
