"""Composed plans: the retrieval service over a chunk store."""
