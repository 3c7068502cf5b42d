"""Relational, graph, similarity and model operators."""
