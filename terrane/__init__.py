"""Corpus, graph, retrieval and learning analytics as Spark DataFrame operators."""
