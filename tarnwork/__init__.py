"""Spark-native retrieval, provenance and curation engine."""

__version__ = "0.1.0"
