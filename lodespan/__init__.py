"""Lodespan: semantic search corpus building and querying on PySpark."""
