"""Readers and writers of tables, listings, manifests and settings."""
