"""Spark-native search, evaluation and data-processing operators over catalogs of images, texts and vectors."""

__version__ = "0.1.0"
