"""Operators for a training-data pipeline over documents, embeddings and images."""
