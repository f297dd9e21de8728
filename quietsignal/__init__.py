"""Outlier and anomaly analytics as Spark DataFrame transformations."""
