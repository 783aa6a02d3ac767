"""Spark-native retrieval-corpus engine: cleaning, chunking, embedding, vector
search, evaluation and dataset reduction as DataFrame transformations."""
