"""Spark-native analytics over damaged media files, declared as DataFrames."""
