"""Loomspan: a Spark-native engine for personal text corpora (ingest, search, distillation, graph)."""
