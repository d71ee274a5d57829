"""Operators of a large training-data pipeline. Nothing outside of this folder imports it."""
