"""Spark-first analytics over digitized chart curves and the documents they come from."""

__version__ = "0.1.0"
