"""Spark-first operators for location catalogs, scoring and the data products around them."""
