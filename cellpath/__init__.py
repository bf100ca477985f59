"""Mobility analytics on Spark: day profiles, day clusters, next-cell prediction."""
