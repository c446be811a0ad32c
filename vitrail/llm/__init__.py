"""Operators for training-data pipelines: vectors, percentiles, clusters, tokens, packing, spam."""
