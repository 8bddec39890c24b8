"""Spark-native facts, graphs and text operators over DataFrames."""
