"""Lodestone: a Spark-first engine that turns files, documents and tables into a typed property graph.

Every operator is a function from DataFrames to a DataFrame; see README.md for the map of the packages.
"""

__version__ = "0.1.0"
