"""Locusframe: a Spark-first engine for annotation features, hierarchies and intervals."""

__version__ = "0.1.0"
