"""Spark-native activity analytics: spans, rollups, entities, graph, vectors and streams as DataFrame functions."""
