"""Relational, graph and data-quality operators."""
