"""Barcode taxonomy analytics as Spark jobs."""

RANKS = ("species", "genus", "family", "order")  # deepest first
METHODS = ("ours", "blast", "naive_bayes", "nearest_neighbor")
FRACTIONS = (0.3, 0.5, 0.7)
