"""Windowed pairwise-similarity analytics on PySpark."""
