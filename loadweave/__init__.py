"""Goods delivery and fleet planning analytics on Spark DataFrames."""
