"""Operators for building training corpora, and the queries that apply them."""
